"""Registered queries: each applies operators of the library to tables derived from the given ones."""
