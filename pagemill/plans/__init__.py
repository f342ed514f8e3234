"""Whole audits and the driver's query catalogue."""
