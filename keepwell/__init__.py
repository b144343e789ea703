"""Customer-churn analytics as Spark DataFrame jobs."""
