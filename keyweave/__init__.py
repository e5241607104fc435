"""Spark-first reconciliation of two data sets by key."""
