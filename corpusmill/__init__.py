"""Text-corpus curation as Spark DataFrame operators."""
