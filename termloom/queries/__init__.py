"""Queries over the test tables: one for each implemented operator, with its SQL."""
