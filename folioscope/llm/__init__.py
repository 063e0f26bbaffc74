"""Training-data operators on passages, pages and documents (one module per problem)."""
