"""Named queries: a callable over a table directory and, where SQL can say it, the same in SQL."""
