"""The analysis, one module per step."""
