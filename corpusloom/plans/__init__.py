"""Query modes composed of the operators."""
