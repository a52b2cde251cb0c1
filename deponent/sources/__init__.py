"""Readers: tables and raw artifacts."""
