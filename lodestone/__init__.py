"""A Spark-native retrieval and text-analytics engine over chunks of source trees."""

__version__ = "0.1.0"
