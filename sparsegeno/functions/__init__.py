"""Cell formulas and helpers that turn them into passes over a panel."""
