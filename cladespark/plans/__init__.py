"""Choice of algorithm, and the registered queries."""
