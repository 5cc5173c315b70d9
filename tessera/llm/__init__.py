"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it.  ``tessera.llm.registry`` lists
its queries and their SQL.
"""
