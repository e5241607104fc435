"""Readers of spreadsheet files and writers of results."""
