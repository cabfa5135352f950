"""DataFrame operators: policy, pages, facts, entities, scoring, enrichment, export."""
