"""Column -> Column scalar functions (text, labels, array math)."""
