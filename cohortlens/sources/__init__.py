"""Readers and writers of the file formats the pipelines exchange."""
