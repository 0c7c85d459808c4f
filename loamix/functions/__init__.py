"""Column functions: tokenizers, n-grams, URLs, HTML."""
