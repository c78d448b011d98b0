"""Operators for preparing text at scale. Nothing else in the package imports this folder."""
