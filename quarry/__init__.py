"""Spark-native relationship, diagnostics and text analytics."""
