"""Operators for preparing training text. Nothing else in corpuslab imports this subpackage."""
