"""Operators: tables in, tables out, keyed by subject and test."""
