"""Operators of a training-data pipeline over documents, pages, conversations and embeddings.

Nothing else in the library imports this package; ``__spark_entry__`` adds its queries
when it is present. One module per operator, ``queries`` registers them.
"""
