"""Training-data operators for corpora: one module per operator, their queries in ``queries.py``.

Nothing else in the library imports this subpackage.
"""
