"""Operators of a training-data pipeline over text corpora.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` binds the operators to
the synthetic tables and ``oracles`` holds the SQL that checks them.
"""
