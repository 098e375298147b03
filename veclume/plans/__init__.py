"""Configurations and the named queries."""
