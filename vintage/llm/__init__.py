"""Training-data operators: deduplication, decontamination, filtering, packing.

Self-contained: it imports nothing from the rest of the library, and the rest
of the library imports nothing from here.
"""
