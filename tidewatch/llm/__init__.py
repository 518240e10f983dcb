"""Training-data operators: licences, near duplicates, secrets, URLs, tokens, language models, contamination, quality."""
