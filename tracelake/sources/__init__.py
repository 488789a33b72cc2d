"""Readers and writers of trace files, test logs, reports, run indexes and project sources."""
