"""Queries over the data tables, one or more for each operator, with SQL twins."""
