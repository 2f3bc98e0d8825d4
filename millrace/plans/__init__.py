"""Plans of several stages."""
