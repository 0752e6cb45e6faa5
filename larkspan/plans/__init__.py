"""Whole queries: adapters over the driver's tables, the catalogue and its SQL."""
