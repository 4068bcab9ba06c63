"""Named views over a set of source files."""
