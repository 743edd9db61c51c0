"""Registered queries with their SQL twins, and the composed training and grading runs."""
