"""Training-data operators: quality, language, near-duplicates, toxicity, decontamination, repeats, PII, packing, secrets.

Nothing outside this subpackage imports it.
"""
