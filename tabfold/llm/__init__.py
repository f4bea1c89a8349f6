"""Operations of a training-data pipeline: deduplication, filters, sharding, token ids.

One module per operator, ``queries.py`` for the registered queries.
"""
