"""Helpers for the registered queries; the library does not use them."""
