"""Dining-menu, nutrition and calendar analytics as Spark DataFrame operators."""

from .session import build_session, checkpoint_ready, configure

__all__ = ["build_session", "checkpoint_ready", "configure"]
