"""Spark-first analytics for biological sequences: chunks, k-mers, windows, interval labels and training examples."""
