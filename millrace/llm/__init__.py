"""Corpus-scale operators for language-model training data.

Nothing outside this subpackage imports it; ``millrace.llm.registry`` lists its
queries and their SQL.
"""
