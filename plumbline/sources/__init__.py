"""Schemas, connections, readers, result storage and targets."""
