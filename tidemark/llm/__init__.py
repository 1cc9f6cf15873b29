"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; the query registry is in
``tidemark.llm.queries``.
"""
