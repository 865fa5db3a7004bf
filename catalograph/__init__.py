"""Catalog analytics as Spark plans: filters, joins, facets, revisions, relevance, access, quality and streams."""
