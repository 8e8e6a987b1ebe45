"""The HTTP surface over the query plans."""
