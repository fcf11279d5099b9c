"""Training-data operators: deduplication, filtering, scanning, packing and output formats.

Nothing else in the library imports this subpackage.
"""
