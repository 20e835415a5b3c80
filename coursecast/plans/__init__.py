"""Whole jobs: training, scoring, reporting, and the registered queries."""
