"""inkwell: a Spark-native analytics engine for linked document corpora."""

__version__ = "0.1.0"
