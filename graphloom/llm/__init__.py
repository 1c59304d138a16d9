"""Operators on texts and measurements for training data. Nothing outside this subpackage imports it."""
