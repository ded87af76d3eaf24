"""Training-data operators: quality, language models, duplicates, tokens, mixing, URLs, neighbours, toxicity."""
