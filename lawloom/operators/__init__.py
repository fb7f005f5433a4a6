"""Operators over tables of laws, operation tables and evidence."""
