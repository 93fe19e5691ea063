"""Operators for preparing language-model training data, each usable on any DataFrame."""
