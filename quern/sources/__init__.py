"""Scans of search responses, records and configuration."""
