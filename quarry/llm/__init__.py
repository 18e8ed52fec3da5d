"""Training-data operators: one module for each, and ``queries`` for the thin contract queries."""
