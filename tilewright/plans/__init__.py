"""Whole plans: detection, training sets, and what they keep between steps."""
