"""Training-data operators: each module holds one operator and the query that applies it."""
