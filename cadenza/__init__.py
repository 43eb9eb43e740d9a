"""cadenza: speech-pipeline analytics as PySpark DataFrame jobs."""
