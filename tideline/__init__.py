"""Association findings from sparse daily series, and corpus preparation, on Spark."""
