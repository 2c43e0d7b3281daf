"""Operators of a training-data pipeline: dedup, decontamination, quality, tokens, packing.

Nothing else in the library imports this subpackage. Each module is one operator;
``queries`` registers one query per operator over the test tables.
"""
