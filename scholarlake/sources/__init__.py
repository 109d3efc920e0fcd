"""Document schemas, decoding and the adapter over star-schema tables."""
