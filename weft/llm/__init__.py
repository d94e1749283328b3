"""Training-data operators: tokenising, deduplication, scanning, filtering, language ID, sharding and packing.

Nothing outside this subpackage imports it.  Each module holds one operator with a general interface; ``queries`` holds
the thin queries that reduce an operator's real outputs (texts, spans, ids) to digest columns.
"""
