"""Operators over DataFrames: filters, queries, offers, merging and workflows."""
