"""The analytics, one module per business segment.

Every operator is ``op(tables, **params) -> DataFrame`` and only builds a plan.
"""
