"""Spark-native engine for building, grading and analysing board-game question benchmarks."""
