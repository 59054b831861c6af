"""Operators for training-data corpora over ``documents``. Nothing else in the library imports this subpackage."""
