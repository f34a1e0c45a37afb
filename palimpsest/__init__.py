"""Spark-native engine for facts, rules, differences and patterns over versioned artefacts."""
