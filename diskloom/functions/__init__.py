"""Column functions: binary decoding, 8.3 names and paths, attributes, timestamps, display."""
