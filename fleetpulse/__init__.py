"""Telemetry windows, pattern prototypes and failure evaluation as Spark DataFrame jobs."""

from fleetpulse.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
