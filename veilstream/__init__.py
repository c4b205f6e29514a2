"""Policy-driven, time-varying privacy transformation of keyed readings on Spark."""
