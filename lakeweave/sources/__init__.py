"""Sources that Spark has no reader for, and file metadata."""
