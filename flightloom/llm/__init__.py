"""Training-data operators: each module holds one operator, `queries` the thin registered queries."""
