"""Spark-first preparation and evaluation of labelled text corpora."""
