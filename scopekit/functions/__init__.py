"""Column expressions. Every function takes and returns ``Column`` objects and
stays inside Spark's built-in (code-generated) expression set."""
