"""kinweave: social-network graph analytics as PySpark DataFrame jobs."""
