"""harrow: batch and streaming Spark jobs for web-harvest data."""
