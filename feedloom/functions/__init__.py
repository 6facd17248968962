"""Column expressions: everything here compiles to Catalyst built-ins, except
the one Unicode decomposition that Spark has no built-in for."""
