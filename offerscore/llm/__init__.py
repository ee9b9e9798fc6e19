"""Operators for building language-model training corpora.

Each module is one operator (see README, "Training-data operators"); ``catalog``
holds the registered queries.  Nothing outside this package imports it.
"""
