"""Writers: JSON lines, Parquet, keyed upsert snapshots and reports."""
