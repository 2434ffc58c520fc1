"""Column functions: numbers, texts, predicates, and the normalisation of raw works."""
