"""Sinks: chart data and model artefacts written to shared storage."""
