"""Operators for preparing training data at scale; see the README for the contracts."""
