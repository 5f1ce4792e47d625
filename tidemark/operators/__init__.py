"""Change-log, chunk and event operators as DataFrame transformations."""
