"""Relational operators over fingerprints, postings and mappings."""
