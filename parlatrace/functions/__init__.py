"""Column functions: time, text, labels, HTML."""
