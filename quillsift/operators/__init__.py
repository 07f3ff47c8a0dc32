"""Index construction, ranking, positional search, correction, snippets, evaluation."""
