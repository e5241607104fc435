"""Reconciliation of streams."""
