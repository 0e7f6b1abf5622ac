"""Column functions: text, numbers, and the pandas-backed ones Spark lacks."""
