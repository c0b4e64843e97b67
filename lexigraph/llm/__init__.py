"""Training-data operators: filtering, deduplication, tokenising, sharding and formatting of document tables.

Nothing outside this subpackage imports it. Each module holds one operator with its own general interface;
``queries`` derives from them the thin, fixed-shape queries that the driver runs.
"""
