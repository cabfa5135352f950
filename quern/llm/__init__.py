"""Operators of a training-data pipeline: deduplication, token counts, decontamination, packing, language, stores, filters."""
