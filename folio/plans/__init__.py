"""Named queries over the driver tables, with SQL that gives the same rows."""
