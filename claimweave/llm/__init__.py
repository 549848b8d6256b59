"""Operators for preparing language-model training corpora.

Each module holds one operator with a general interface; ``queries`` wires the
thin ``opN_*`` queries and their SQL.  Nothing outside this package imports it.
"""
