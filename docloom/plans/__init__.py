"""Plans: the corpus API, and the registered queries."""
