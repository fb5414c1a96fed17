"""DataFrame-to-DataFrame operators on panels (entity, date, ...)."""
