"""Ferngraph: a Spark-native engine for dependency graphs, change risk and telemetry."""
