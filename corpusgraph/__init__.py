"""Spark-first analytics over corpora that are both text and graph."""
