"""Spark-native transcription-quality engine: DataFrame in, DataFrame out."""
