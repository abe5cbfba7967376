"""Vector stores on Spark: exact top-k search, metadata filters, upserts, 8-bit quantization and snapshots."""
