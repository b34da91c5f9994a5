"""Importing this module registers every query."""

from leafline.catalog import blocks, documents, functions, layout, plans, streams, words  # noqa: F401
