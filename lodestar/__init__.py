"""lodestar: a Spark-native document analytics and candidate search engine."""

__version__ = "0.1.0"
