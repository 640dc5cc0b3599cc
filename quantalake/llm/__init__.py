"""Training-data operators: quality, packing, language, fingerprints, deduplication, decontamination, token files, chat."""
