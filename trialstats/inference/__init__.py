"""Hypothesis tests computed from grouped aggregates."""
