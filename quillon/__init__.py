"""quillon: a PySpark-native context-retrieval and corpus-processing engine."""

__version__ = "0.1.0"
