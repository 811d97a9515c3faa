"""Plans made of several operators: the position pipeline and its settings."""
