"""Readers and writers of framed record logs."""
