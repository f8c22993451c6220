"""Growth and product analytics as Spark DataFrame operators."""

from tideline.session import build_session

__all__ = ["build_session"]
