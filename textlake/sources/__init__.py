"""Readers and writers of corpora, dictionaries, vectors and models."""
