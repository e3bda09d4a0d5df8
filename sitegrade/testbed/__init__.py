"""Observation, log and source tables derived from the driver's parquet tables, for checks."""
