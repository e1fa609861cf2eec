"""weftline: a Spark-native engine that turns scattered evidence into entities."""

__version__ = "0.1.0"
