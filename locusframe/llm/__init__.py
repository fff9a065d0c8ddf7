"""Training-data operators: one module each, queries in ``queries``.

Nothing outside this folder imports it.
"""
