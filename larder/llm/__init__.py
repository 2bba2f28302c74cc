"""Corpus preparation for language models: near copies, leaks, scoring, filtering, packing, archives.

Operators take dossiers (``recipe_id``, ``text``) or fetched pages (``page_id``, ``source_url``,
``html``) and return DataFrames. Nothing else in the library imports this package.
"""
