"""Scalar expressions: boxes, clock times, address text."""
