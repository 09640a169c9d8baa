"""Spark-native analytics for the data of model training and evaluation."""
