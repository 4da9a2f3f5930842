"""Evidence views, queries and plan helpers."""
