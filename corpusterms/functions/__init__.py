"""Column expressions: token grammar, in-row counting, markup chains, IDF."""
