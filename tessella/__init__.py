"""Tessella: numeric arrays, binary fingerprints and similarity search as Spark jobs."""
