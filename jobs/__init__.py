"""Runnable jobs: ``python -m jobs.NAME --help``. Each has its work in a function that takes a
session, reads and writes by Spark alone, and can be run again with the same result."""
