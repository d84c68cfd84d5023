"""roadlens: road-traffic analytics as Spark DataFrame operators."""
