"""Scans as streams."""
