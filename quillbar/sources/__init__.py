"""Readers, writers, generators and the inputs of the registered queries."""
