"""Fleet analytics for a shared GPU pool, written as Spark DataFrame functions."""
