"""DataFrame operators: joins, aggregates, ranks, store and monitoring."""
