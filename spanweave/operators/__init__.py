"""Operators over sensitive spans, mask timelines and their audit."""
