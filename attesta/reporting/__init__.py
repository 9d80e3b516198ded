"""Lineage, profiles and the dashboard."""
