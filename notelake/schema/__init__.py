"""File classes: their registry, hierarchy and inheritance."""
