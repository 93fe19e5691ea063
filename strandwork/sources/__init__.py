"""Readers and writers of sequence, annotation and taxonomy files, and adapters over other tables."""
