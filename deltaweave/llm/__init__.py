"""Training-data operators for large corpora; see ``queries.py`` for the registered queries."""
