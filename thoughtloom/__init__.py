"""Decision-knowledge analytics as Spark DataFrame plans."""
