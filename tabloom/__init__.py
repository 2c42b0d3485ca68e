"""Tabular data preparation and tabular models as plain Spark DataFrame jobs."""

from tabloom.session import get_session
from tabloom.types import Roles

__all__ = ["Roles", "get_session"]
