"""Folioscope: a Spark-first engine for crawled documentation corpora."""

__version__ = "0.1.0"
