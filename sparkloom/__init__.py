"""A model-driven query engine on Spark: a schema with relations, nested queries compiled to DataFrame plans."""
