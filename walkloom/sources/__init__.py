"""Readers and writers: tables, graph and sequence views, codebooks, vocabularies, splits, reports."""
