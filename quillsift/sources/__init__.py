"""Where collections come from and where indexes and reports go."""
