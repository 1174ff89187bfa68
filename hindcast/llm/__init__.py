"""Operators of a training-data pipeline: each module holds one, with its ``opN_`` query.

Modules that look at every word work on blocks (see ``blocks``): a task packs the words of some
megabytes of text into arrays, asks the owners of their distinct keys one question a key, and gets
the answers back in the same order.  A key costs one entry a block however often it occurs.
"""
