"""Correctness checks: every operator run on the given tables, next to the same question in SQL."""
