"""DataFrame operators on flow records: predicates, deduplication, the exporter dimension, statistics."""
