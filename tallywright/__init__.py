"""Sales analytics on Spark: keyed ingest, product grouping and exact reports.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark's own
expressions; actions happen only in the jobs of :mod:`tallywright.plans`.
"""
