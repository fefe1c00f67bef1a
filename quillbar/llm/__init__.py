"""Operators for building training data from document collections."""
