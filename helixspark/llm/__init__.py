"""Operations of a training-data pipeline over text tables.

Self-contained: nothing else in the library imports this subpackage, and it imports nothing from the rest.
"""
