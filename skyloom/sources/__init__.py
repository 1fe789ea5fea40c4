"""Readers: flight logs, check-points, point clouds, run manifests, layered settings."""

from .telemetry import read_telemetry

__all__ = ["read_telemetry"]
