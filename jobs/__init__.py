"""Runnable jobs: each file has a function that takes a session and plain paths, and a command line."""
