"""spanledger: a PySpark-native engine for usage logs, transcripts and the data pipelines around them."""

__version__ = "0.1.0"
