"""Analytics over append-only observation logs, as PySpark DataFrame operators."""
