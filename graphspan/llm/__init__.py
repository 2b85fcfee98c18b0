"""Operators for large training-text pipelines.

Nothing outside this subpackage imports it; ``queries.py`` registers one query
per operator.  Worker-side code is imported by name, so on a cluster the package
has to be on the executors' Python path (``--py-files`` or an installed wheel).
"""
