"""Training-data operators: ten self-contained Spark operators and their registered queries.

Nothing outside this subpackage imports it.
"""
