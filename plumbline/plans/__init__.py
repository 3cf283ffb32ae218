"""Whole plans: queries, reports, settings, command line."""
