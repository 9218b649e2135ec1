"""Operators for preparing large text corpora, each usable on its own.

Nothing outside this subpackage imports it.  ``queries`` holds the thin query
wrappers; every other module is one operator with its general interface.
"""
