"""gaugeflow: analytics for monitoring data, written as Spark DataFrame plans."""
