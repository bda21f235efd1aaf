"""tessera: a Spark-native document memory and retrieval engine."""

__version__ = "0.1.0"
