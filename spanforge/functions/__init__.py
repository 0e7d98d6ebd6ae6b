"""Column functions: byte strings, masking, normalisation, paths."""
