"""Training-data operators: decontamination, sharding, quality, PII, duplicates,
token output, token counts, line duplicates, packing and near duplicates.

Nothing outside this folder imports it. Every operator takes a DataFrame with
``doc_id`` and ``text`` (further columns are ignored or carried) and returns a
DataFrame; intermediate tables are written below ``spark.checkpoint.dir``.
"""
