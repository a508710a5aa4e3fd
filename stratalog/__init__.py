"""Versioned key-value analytics on Spark: the mutation log is the truth, everything else is a DataFrame over it."""
