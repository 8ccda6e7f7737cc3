"""Column functions: URL keys, HTTP records, link patterns."""
