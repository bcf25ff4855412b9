"""Jobs that string operators together, and the registered queries."""
