"""Transaction risk analytics on a star schema, as PySpark DataFrame operators."""
