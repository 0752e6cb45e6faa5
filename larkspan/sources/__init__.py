"""Readers and writers. Paths are read by Spark, so any file system that it knows will do."""
