"""Spark jobs that curate speech-training data, and text-corpus jobs beside them."""
