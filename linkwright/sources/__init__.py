"""sources of the linkage library."""
