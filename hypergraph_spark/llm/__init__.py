"""Training-data operators: ten corpus operators, their queries and oracle SQL.

Nothing else in the package imports this subpackage.
"""
