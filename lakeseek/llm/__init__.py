"""Training-data operators: fingerprints, filters, near-duplicate removal, redaction, tokenising."""
