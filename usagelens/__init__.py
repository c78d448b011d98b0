"""usagelens: usage analytics for compute clusters and file systems on PySpark."""
