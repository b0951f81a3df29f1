"""Training-data operators: one module per operator, its queries in ``entries``."""
