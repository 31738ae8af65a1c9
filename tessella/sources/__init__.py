"""Readers and writers, and the domain tables derived from the test tables."""
