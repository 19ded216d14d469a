"""frameloom: Spark-native retrieval analytics over timestamped frame archives."""

__version__ = "0.1.0"
