"""Spark-native analytics for urban air quality, traffic and public health.

Everything is a function from DataFrames to a DataFrame. Nothing runs until the
caller writes or shows a result, apart from intermediate tables whose size is read.

- ``airzone.sources``    typed loads, literal dimensions, staged tables
- ``airzone.functions``  column expressions (calendar, rounding, geodesy, WKT)
- ``airzone.operators``  reusable relational steps (audits, percentiles, nearest)
- ``airzone.plans``      the analyses themselves
"""
