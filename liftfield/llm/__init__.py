"""Operators of a training-data pipeline: quality, duplicates, tokens, language, toxicity, mixing, licences, decontamination."""
