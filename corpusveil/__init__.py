"""Pseudonymize large text and source-code corpora with Spark, and undo it again."""
