"""lexoria: a Spark-native engine for lexicon evidence, scoring, search and change feeds."""

__version__ = "0.1.0"
