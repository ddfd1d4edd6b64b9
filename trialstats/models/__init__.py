"""Regression models fitted from distributed sufficient statistics."""
