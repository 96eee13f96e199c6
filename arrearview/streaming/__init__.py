"""Intentionally empty: every table of the loan book is a full refresh, nothing is streamed."""
