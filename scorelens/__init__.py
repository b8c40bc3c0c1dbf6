"""scorelens — survey / score-card analytics as lazy Spark DataFrame operators.

Every operator is a pure function ``op(df, ...) -> DataFrame`` that builds a
logical plan; nothing is collected unless the operator must make a driver-side
decision on a small, bounded result (kept features, number of components).
"""

__version__ = "0.1.0"
