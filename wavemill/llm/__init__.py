"""Operators for preparing training data: sequences, near copies, shared spans, tokens, mixtures, encodings."""
