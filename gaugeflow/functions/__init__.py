"""See the package docstring of gaugeflow."""
