"""Query catalogue: one callable per query, with the matching SQL where SQL can state it."""
