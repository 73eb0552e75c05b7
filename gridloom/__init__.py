"""Batched zone-cover analytics on Spark."""

from gridloom.session import get_session

__all__ = ["get_session"]
