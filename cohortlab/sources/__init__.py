"""Readers and writers for the file formats around the operators."""
