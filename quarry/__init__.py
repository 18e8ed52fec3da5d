"""Source-code analytics as Spark DataFrame transformations."""
