"""Operators for preparing training data at scale.

Nothing else in the library imports this package.  ``queries.QUERIES`` holds
one query per operator over its whole intended table and ``queries.ORACLE``
the SQL twins where SQL can state the operator.
"""
