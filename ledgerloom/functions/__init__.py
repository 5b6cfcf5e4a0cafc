"""See the package docstring of ledgerloom."""
