"""Operators on text for language models. Nothing outside this subpackage imports it."""
