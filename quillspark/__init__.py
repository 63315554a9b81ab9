"""Document-collection analytics expressed as Spark DataFrame plans."""
