"""filingloom: Spark-native operators for page-level filing text and question records."""

__version__ = "0.1.0"
