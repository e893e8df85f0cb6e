"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it. ``entry.queries()`` lists its
queries, ``entry.oracle_sql()`` their SQL where SQL can express them.
"""
