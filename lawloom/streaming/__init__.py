"""Labelling streams of equations against the static catalogue."""
