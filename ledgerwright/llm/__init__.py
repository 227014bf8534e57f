"""Training-data operators: quality, deduplication, extraction, packing and storage.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; Python runs only inside Arrow batches that Spark deals out.
"""
