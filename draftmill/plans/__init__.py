"""Input relations, settings and the catalogue of registered queries."""
