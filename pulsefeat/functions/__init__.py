"""Column functions with the engine's null, infinity and near-zero rules."""
