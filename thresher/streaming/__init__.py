"""The index and the frontier as streams."""
