"""Operation logs over tables, and a Parquet store of sorted runs."""
