"""Parsers from landed payload tables to raw articles."""
