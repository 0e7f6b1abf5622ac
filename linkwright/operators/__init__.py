"""operators of the linkage library."""
