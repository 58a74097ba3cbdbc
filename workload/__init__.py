"""The registered queries: each operator on views of the given tables, beside its SQL."""
