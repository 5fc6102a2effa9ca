"""Tidemark: a PySpark-native customer analytics and corpus-preparation engine."""
