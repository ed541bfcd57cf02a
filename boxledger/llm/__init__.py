"""Operators for training text: mixing, joins and dedup, formatting, scoring, counting, extraction.

Each works on document texts of the project (``common.document_texts`` makes them from field readings) or, where the
project has no such records, on any table of pages or conversations. Nothing else in the library imports this package.
"""
