"""A PySpark-native engine for music-catalogue analytics, recommendation and evaluation."""
