"""Token compression and request analytics expressed as Spark DataFrame plans."""
