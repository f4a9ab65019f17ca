"""Column expressions: cleaning, tokens, similarity."""
