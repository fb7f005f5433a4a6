"""Column functions over encoded terms and equation text."""
