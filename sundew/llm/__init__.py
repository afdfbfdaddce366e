"""Training-data operators: mixing, token files, near duplicates, language models, decontamination, quality, nearest
neighbours, personal data, secrets and language identification. Nothing outside this package imports it."""
