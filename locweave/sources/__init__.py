"""Readers of sitemaps, lists and exports, and writers of cleaned ones."""
