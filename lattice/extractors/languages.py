"""Imports every extractor, so that all are registered."""

from lattice.extractors import golang, java, markdown, python, rust, typescript  # noqa: F401
