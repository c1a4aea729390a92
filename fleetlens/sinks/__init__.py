"""Where results go: keyed Parquet tables and operational databases."""
