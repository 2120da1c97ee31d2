"""Customer-churn analytics written as Spark DataFrame operators."""
