"""Runnable jobs on the law engine: each has a function on a session, a command line and a small config file."""
