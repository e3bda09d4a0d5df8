"""Expression builders.

Every function takes and returns Spark SQL text, for ``selectExpr`` and ``F.expr``: a wide plan has
hundreds of expressions, and text reaches Spark in one call each. No Python runs per row.
"""
