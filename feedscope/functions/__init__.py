"""Functions of the feed and measurement engine."""
