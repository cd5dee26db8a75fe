"""Operators put together into the full jobs."""
