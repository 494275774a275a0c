"""Operators of a training-data pipeline, each usable on any DataFrame.

Nothing outside this subpackage imports it.  ``queries.py`` holds the registered queries.
"""
