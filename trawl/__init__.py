"""Trawl: a PySpark-native engine for focused-crawl corpora."""
