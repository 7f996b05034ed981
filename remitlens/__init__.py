"""Claim denial-risk analytics as Spark DataFrame plans."""
