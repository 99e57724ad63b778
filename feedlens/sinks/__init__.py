"""Rendering of articles and repositories as JSON, Markdown and plain text."""
