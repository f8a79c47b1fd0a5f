"""The jobs from end to end."""
