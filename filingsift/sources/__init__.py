"""Readers, writers and reusable materialised tables."""
