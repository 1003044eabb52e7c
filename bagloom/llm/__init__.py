"""Corpus operators for training-data pipelines (nothing else in bagloom imports this subpackage)."""
