"""Operators for texts that train language models. Nothing else in the library imports this subpackage."""
