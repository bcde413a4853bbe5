"""Whole queries: quality control, roll-ups, regression and the catalog."""
