"""Operators for preparing training data.

Nothing outside this subpackage imports it.  Each ``opN_*`` module holds one
operator, the thin query that applies it to a whole table and, where SQL can
express the result, the SQL it is checked with; ``registry`` collects them.
"""
