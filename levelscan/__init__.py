"""Early-warning analytics on level-ordered series, written as PySpark DataFrame operators."""
