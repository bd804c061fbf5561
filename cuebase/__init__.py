"""Spark-native operators over sound-program archives, signals and command logs."""
