"""Registered queries: each takes a session and a dataset folder and returns a DataFrame."""
