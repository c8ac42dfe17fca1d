"""Readers of log lines, imports and daily documents."""
