"""Training-data operators: deduplication, filtering, packing, tokenising.

Nothing outside this folder imports it.  ``registry.queries()`` and
``registry.oracle_sql()`` list its queries.
"""
