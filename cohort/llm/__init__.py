"""Training-data operators: deduplication, quality, mixing, decontamination, secrets,
toxicity, language-model scoring and web archives, each a Spark job over whole tables."""
