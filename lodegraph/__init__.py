"""lodegraph: a Spark-native knowledge-graph and lexical-search engine."""

__version__ = "0.1.0"
