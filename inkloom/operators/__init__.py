"""DataFrame-to-DataFrame operators, keyed by image, path or run."""
