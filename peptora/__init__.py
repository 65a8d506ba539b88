"""Protein sequence analytics on Spark."""
