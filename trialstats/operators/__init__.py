"""Relational operators: recodes, joins, summaries, windows, order statistics."""
