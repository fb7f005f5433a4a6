"""Readers and writers of law catalogues, evidence and reports."""
