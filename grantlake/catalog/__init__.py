"""The registered queries: a permission graph derived from the star-schema tables, and what each operator answers on it."""
