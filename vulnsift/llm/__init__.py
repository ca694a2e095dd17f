"""Training-data operators: ten DataFrame operators and the queries that apply them to whole tables.

Nothing outside this subpackage imports it.
"""
