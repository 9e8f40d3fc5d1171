"""lattica: particle-trajectory analytics expressed as Spark DataFrame transformations."""
