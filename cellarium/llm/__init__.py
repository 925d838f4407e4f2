"""Training-data operators: search, privacy, packing, decontamination, filters, token files, extraction, deduplication.

Nothing else in the library imports this subpackage.
"""
