"""Operators on telemetry frames."""
