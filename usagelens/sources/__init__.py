"""Readers: scheduler logs, file-system scans and the driver's tables."""
