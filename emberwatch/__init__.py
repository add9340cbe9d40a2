"""Security log analytics as Spark DataFrame plans."""
