"""Training-data operators: tokenising, packing, filtering, deduplication and search over document tables.

Nothing outside this folder imports it.  ``tidelog.llm.queries`` registers the queries.
"""
