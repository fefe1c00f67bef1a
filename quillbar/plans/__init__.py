"""End-to-end runs and the catalogue of registered queries."""
