"""Spark operators over two-party conversation data, and a training-data toolkit in ``llm``."""
