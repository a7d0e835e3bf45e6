"""Operators for training-data pipelines: filters, near duplicates, scoring, mixing and sharding of documents.

Nothing outside this folder imports it. Common rules: a null text is an empty text unless an operator says
otherwise; only the columns an operator names are read, so further columns never clash; rows are never
dropped to escape skew.
"""
