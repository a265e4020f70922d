"""Operators of a large-scale training-data pipeline.

Each module is one operator; ``queries`` binds them to the driver tables and ``oracles``
holds the DuckDB SQL of those that SQL can express. Nothing outside this subpackage
(but ``corpus_pipeline.py`` and the guarded registration in ``__spark_entry__.py``) imports it.
"""
