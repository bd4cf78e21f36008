"""Landed sources and the adapters that bring them to one record."""
