"""leadloom: lead discovery, scoring and reporting as PySpark DataFrame jobs."""
