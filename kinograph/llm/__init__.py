"""Operators for large text corpora: near duplicates, licences, fingerprints, decontamination, sharding, archives,
quality, tokenizing, language-model scores and language identification."""
