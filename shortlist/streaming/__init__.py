"""Structured Streaming jobs and the batch forms they share code with."""
