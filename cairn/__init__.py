"""Block-store analytics on Spark: content-defined chunks, global deduplication, representation planning and recovery."""
