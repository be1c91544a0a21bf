"""Relational operators of retrieval, grounding and the guarded SQL surface."""
