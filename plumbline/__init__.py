"""plumbline: a PySpark-native data-quality and corpus-processing engine."""

__version__ = "0.1.0"
