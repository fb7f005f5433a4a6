"""Operators for preparing language-model training data at corpus scale.

One module per operator.  Each module documents its input contract (nulls,
empty tables, ties, repeated rows, extra columns) and has a thin
``opN_<name>`` query that applies it to a whole table.
"""
