"""Job-market analytics on PySpark: ingest, normalization, star schema, demand views."""
