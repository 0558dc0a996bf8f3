"""The scan on a stream of files."""
