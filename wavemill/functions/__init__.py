"""Column expressions and array codecs."""
