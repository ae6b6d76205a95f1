"""Site-reliability analytics expressed as Spark DataFrame operators."""
