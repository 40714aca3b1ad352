"""Training-data operators: language ID, WARC, mixing, fingerprints, chat formatting, token files,
packing, near-duplicate search and sharding.  Nothing else in the library imports this package."""
