"""Training-data operators: each module is one operator with a DataFrame-in, DataFrame-out interface.

Nothing else in the library imports this subpackage; ``registry`` holds its queries and their SQL.
"""
