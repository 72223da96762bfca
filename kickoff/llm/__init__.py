"""Training-data operators over a table of documents (``doc_id``, ``text``, ...).

Nothing else in the library imports this package; ``__spark_entry__`` adds its
queries when the package is present.
"""
