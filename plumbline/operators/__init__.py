"""Metrics, trends, checks and derived sources."""
