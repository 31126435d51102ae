"""Online features: per-machine state, replay of stored rows, and a Structured Streaming operator."""
