"""Readers and writers: image files, SVG text, metric tables, the run log."""
