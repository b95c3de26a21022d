"""Spark-first analytics over multi-speaker transcripts."""
