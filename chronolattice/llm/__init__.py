"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it. Queries over the test tables are in ``queries``.
"""
