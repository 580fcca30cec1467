"""Complete runs composed of the operators."""
