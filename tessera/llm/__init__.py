"""Operators of a training-data pipeline (near-duplicates, packing, decontamination, ...)."""
