"""Corpus operators for training-data work. Optional: nothing outside this sub-package imports it."""
