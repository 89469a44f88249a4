"""Sources: the Parquet tables of the queries, and key-value stores' own files."""
