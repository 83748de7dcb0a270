"""Readers and writers: Arrow IPC files, answers as CSV, result tables."""
