"""Spark-native signal, event and statistics operators: DataFrame in, DataFrame out."""
