"""Rendering of works: citation styles and export formats."""
