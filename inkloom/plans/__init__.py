"""Physical layout helpers, derived tables and the query catalogue."""
