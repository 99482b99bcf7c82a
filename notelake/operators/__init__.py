"""Transforms and terminals over relations of pages and tasks."""
