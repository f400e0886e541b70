"""Operators of a training-data pipeline: tokens, language models, duplicates, pages, archives and search."""
