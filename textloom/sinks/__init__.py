"""Sinks of converted text: Markdown files, bundles, HTML, word-processing documents."""
