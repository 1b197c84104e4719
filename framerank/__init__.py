"""Scoring, classifying, de-duplicating and ranking photo collections with Spark DataFrames."""
