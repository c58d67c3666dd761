"""Operators for training-data pipelines over the `documents`, `pages`, `benchmark` and `labels` tables.

Nothing outside this folder imports it.  `registry.QUERIES` and `registry.ORACLES` hold the
queries that `__spark_entry__.py` adds when the folder is there.
"""
