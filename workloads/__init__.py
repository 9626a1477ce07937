"""Fixture views, registered queries and their SQL counterparts."""
