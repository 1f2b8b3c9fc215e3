"""Scalar building blocks: JSON values with one total order, and lower-casing."""
