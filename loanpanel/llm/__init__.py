"""Training-data operators: dedup, scans, classifiers, search, packing and token files.

Nothing else in the library imports this subpackage.
"""
