"""Relational operators and expressions with PostgreSQL's semantics."""
