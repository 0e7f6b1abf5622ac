"""plans of the linkage library."""
