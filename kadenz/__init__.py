"""kadenz: multimodal time-series analytics as Spark DataFrame operators."""
