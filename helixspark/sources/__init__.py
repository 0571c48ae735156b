"""Readers and writers of biological file formats, all through Spark's own file sources."""
