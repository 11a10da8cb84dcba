"""Operators of a training-data pipeline over text and embedding tables.

Every module holds one operator with a general interface; ``queries`` binds
them to the tables of a data folder.  Nothing outside this subpackage imports
it, so it can be removed without touching the rest of the library.
"""
