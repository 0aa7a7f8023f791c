"""Training-data operators: one module each, queries and oracle SQL in ``queries``."""
