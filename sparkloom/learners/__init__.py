"""Learners: fitted by aggregates over the table, applied as projections."""
