"""DataFrame -> DataFrame operators: spatial joins, graph clustering, windows, table changes."""
