"""Training-data operators: thirteen Spark jobs over document and embedding tables.

Nothing else in the library imports this package.  Each operator is a module with its own general
interface; ``queries.py`` holds the thin ``opN_*`` queries and ``corpus_pipeline.py`` (repository
top) chains five of the operators.
"""
