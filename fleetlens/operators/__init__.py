"""Operators over captured telemetry."""
