"""Registered queries and their fixture graph."""
