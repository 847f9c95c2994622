"""The registered queries: derived inputs, Spark form and SQL form."""
