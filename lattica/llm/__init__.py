"""Operators for building language-model training data, each usable on any DataFrame."""
