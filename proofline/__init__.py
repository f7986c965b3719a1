"""Evidence-to-verdict analytics on PySpark."""
