"""Column functions with the model's value semantics."""
