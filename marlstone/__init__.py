"""marlstone: a Spark-native document retrieval and graph analytics engine."""

__version__ = "0.1.0"
