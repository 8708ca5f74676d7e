"""Subpackage of keepsake; see the module docstrings."""
