"""See the package docstring of gridloom."""
