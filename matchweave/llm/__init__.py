"""Corpus-preparation operators: dedup, packing, fingerprints, archives, PII,
tokenisation, chat templates, license scans and language identification."""
