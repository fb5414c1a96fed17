"""Where panels come from: bar files, the driver's tables, mappings, lists; and where results go."""
