"""Event-log analytics on Spark: logs, folds, materialized views, replication and codecs as DataFrame operations."""
