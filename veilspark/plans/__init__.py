"""Whole studies: combinations of techniques, reports, model evaluation, tests."""
