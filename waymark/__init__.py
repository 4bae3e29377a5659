"""Frame-and-track analytics as Spark jobs over many videos at once."""
