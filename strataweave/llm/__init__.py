"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage. Each module holds one
operator with a general interface; ``queries`` holds the thin registered
queries and ``oracle_sql`` their SQL, where SQL can express them.
"""
