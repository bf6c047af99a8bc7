"""Operators for corpora of watched texts. Nothing outside this package imports it."""
