"""Training-data operators: ten distributed text operators and their queries.

Nothing outside this subpackage imports it.
"""
