"""Dashboards over growing tables."""
