"""Column-level functions; everything here stays inside Catalyst expressions."""
