"""Candidate-screening analytics on Spark: plain DataFrame-to-DataFrame operators."""
