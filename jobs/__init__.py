"""Runnable jobs. Each has a function that takes a session and plain path arguments, a command line and a config file."""
