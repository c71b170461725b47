"""Domain tables derived from the generated star schema, and the registered queries."""
