"""Training-data operators: dedup, decontamination, scoring, tokenizing, sharding. Nothing else in the library imports this."""
