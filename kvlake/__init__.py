"""Versioned key/value analytics and corpus preparation on PySpark."""
