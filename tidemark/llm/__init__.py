"""Operators on texts measured in tokens of public tokenizers. Nothing outside this folder imports it."""
