"""Distributed analysis of monetary decisions recorded in a star schema of cases.

Every public operator takes and returns Spark DataFrames.  The driver only ever
holds statistics whose size is fixed by the schema or a parameter (one row of
moments, at most a few thousand histogram cells, one importance per feature).
"""
