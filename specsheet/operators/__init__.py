"""DataFrame operators. Each is ``f(df, <column names>, ...) -> DataFrame`` and lazy."""
