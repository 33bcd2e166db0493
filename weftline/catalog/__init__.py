"""Queries over whole tables, each with SQL that gives the same rows."""
