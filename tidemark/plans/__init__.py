"""Registered queries, their fixtures and their oracle SQL."""
