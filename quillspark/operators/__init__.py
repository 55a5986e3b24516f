"""DataFrame operators of the catalog: filters, joins, aggregates, paging, merges, search."""
