"""Scans, sinks and views."""
