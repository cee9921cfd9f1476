"""Operators: the reference's queries, views, procedures, ETL steps and report measures."""
