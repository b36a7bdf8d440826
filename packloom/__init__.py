"""packloom: source-corpus preparation as PySpark DataFrame jobs."""
