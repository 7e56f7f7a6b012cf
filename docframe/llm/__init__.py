"""Operators for large training corpora. Nothing else in docframe imports this subpackage."""
