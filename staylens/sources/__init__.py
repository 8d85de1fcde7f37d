"""Scans, sinks and the stand-in tables used by the registered queries."""
