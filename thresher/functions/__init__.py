"""Column functions: text, codecs and links."""
