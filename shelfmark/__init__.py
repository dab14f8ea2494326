"""shelfmark: a Spark engine that organises, deduplicates, classifies and searches large document corpora."""

__version__ = "0.1.0"
