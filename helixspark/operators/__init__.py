"""Operators whose results depend on order or on dynamic programming: Arrow functions over rows or groups."""
