"""Readers and writers for question, table, vector, neighbour and prediction files."""
