"""Training-data operators.

Nothing outside this subpackage imports it; ``catalogue`` holds the queries and
the SQL that ``__spark_entry__`` registers when the subpackage is present.
"""
