"""Table operators: joins, set operations, aggregations, ordering, lookup."""
