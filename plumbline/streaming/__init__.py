"""Windowed metrics over streams."""
