"""Named queries over the tables of a directory, and their SQL."""
