"""Training-data operators: tokenising, deduplication, filtering, packing and scoring of documents.

Nothing outside this package imports it; ``__spark_entry__`` adds its queries when it is present.
"""
