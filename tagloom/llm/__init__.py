"""Training-data operators: ten corpus operators and their driver queries.

Nothing else in the library imports this subpackage.
"""
