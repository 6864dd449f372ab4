"""Operators on long rows of series and on intervals."""
