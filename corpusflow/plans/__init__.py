"""Fixture derivations and the registry of checked queries."""
