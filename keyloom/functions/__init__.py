"""Column-to-Column helpers. Nothing here reads or shuffles data."""
