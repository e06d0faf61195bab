"""Corpus operators for training-data pipelines; nothing else in keelson imports this."""
