"""Operators of a training-data pipeline over document tables.

The subpackage stands alone: nothing else in the library imports it.
``claimloom.llm.registry`` lists the queries and their SQL twins.
"""
