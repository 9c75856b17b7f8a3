"""Readers of media folders, category settings and caches."""
