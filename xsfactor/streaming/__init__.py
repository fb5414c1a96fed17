"""Optional streams: the batch operators' nearest relatives in Structured Streaming."""
