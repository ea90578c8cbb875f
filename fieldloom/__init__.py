"""Dense scalar and vector fields on Spark."""
