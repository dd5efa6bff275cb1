"""Banking-risk analytics as PySpark jobs: layers, marts, data quality, streams and governance."""
