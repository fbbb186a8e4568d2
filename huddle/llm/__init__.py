"""Operators of a training-data pipeline over a ``documents`` table.

Nothing else in the library imports this package.  Every operator takes and
returns DataFrames; ``huddle.llm.queries`` registers one query per operator.
"""
