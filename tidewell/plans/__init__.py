"""Query plans: the bounded flow query with its pages, and the registered queries."""
