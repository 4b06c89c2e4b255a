"""Training-data operators: quality, sharding, near-duplicates, lines, mixing, archives,
decontamination, substrings, toxicity, secrets.  Nothing else in the library imports this."""
