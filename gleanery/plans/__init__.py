"""Whole dataflows and the registered queries with their derived input tables."""
