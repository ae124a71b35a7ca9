"""Training-data operators: quality, secrets, language, deduplication, tokens, decontamination, privacy, URL lists."""
