"""Training-data operators: decontamination, near-duplicates, token output,
quality rules, repeated passages, mixing, licences, toxicity, line
duplicates and sharding.  Nothing outside this subpackage imports it."""
