"""Readers and writers of decision records."""
