"""Runnable jobs. Each has a command line and a small config file; the work is a function that takes a session."""
