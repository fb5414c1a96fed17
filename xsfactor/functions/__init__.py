"""Column-level building blocks: frames, ranks, guarded moments, special functions."""
