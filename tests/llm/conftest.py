"""Shared by the tests of the training-data operators."""
