"""Scalar helpers used on small result frames."""
