"""Evidence retrieval, QA evaluation and record hygiene on Spark DataFrames."""

__version__ = "0.1.0"
