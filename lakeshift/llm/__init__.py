"""Training-data operators: extraction, deduplication, scoring, mixing, formatting, output.

Nothing else in the library imports this subpackage; ``corpus_pipeline.py`` chains five of
its operators and ``queries.py`` registers one query per operator.
"""
