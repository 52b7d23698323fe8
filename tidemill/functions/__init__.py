"""Column builders: no actions, no shuffles, nothing but expressions."""
