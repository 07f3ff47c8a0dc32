"""The search engine as one object, the registered queries and their SQL."""
