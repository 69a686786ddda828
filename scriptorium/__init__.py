"""Spark-native document analytics: sources, text functions, document operators, plans and streams."""
