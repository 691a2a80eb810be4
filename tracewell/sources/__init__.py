"""Tolerant file scans that yield one raw-record table for every format."""
