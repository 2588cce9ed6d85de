"""Football match, odds and prediction analytics as PySpark DataFrame jobs."""
