"""Field-force planning and corpus preparation on Spark."""
