"""Leakage-safe feature engineering for machine telemetry, as Spark plans."""
