"""Stateful operators over streams, with their batch equivalents."""
