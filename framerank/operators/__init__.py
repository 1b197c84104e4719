"""Operators over catalogs, groups, boxes, overlays and moves."""
