"""postmill: mail-archive analytics on PySpark."""
