"""Operators of record logs, ordered batches, file contents, namespaces and telemetry as DataFrame plans."""
