"""millrace: curation and evaluation of training data as PySpark DataFrame jobs."""
