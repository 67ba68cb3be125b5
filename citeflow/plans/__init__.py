"""Registered queries beside those of the catalogue: checks and schedules, reports and records."""
