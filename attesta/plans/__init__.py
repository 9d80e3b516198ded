"""Reusable multi-step plans."""
