"""specsheet: spec-sheet analytics as lazy Spark DataFrame operators.

Every operator is ``f(df, <column names>, ...) -> DataFrame`` built from Spark SQL
expressions and ``pyspark.ml``; nothing runs until an action is called.
"""

__version__ = "0.1.0"
