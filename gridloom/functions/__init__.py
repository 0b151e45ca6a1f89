"""Column -> Column helpers: text, names, ids, distances, record rules."""
