"""Operators on text and samples for training language models. Nothing outside this subpackage imports it."""
