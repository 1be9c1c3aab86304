"""Reports of candidates."""
