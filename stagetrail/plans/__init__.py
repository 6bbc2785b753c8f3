"""Ready-made analyses over a booking log, a task log and an app log."""

from .journeys import Journeys

__all__ = ["Journeys"]
