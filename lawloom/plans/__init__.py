"""Named queries over the supplied tables, and SQL to check them by."""
