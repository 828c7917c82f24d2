"""Graph operators, layers, training and metrics."""
