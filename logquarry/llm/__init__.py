"""Training-data operators (quality, near-dedup, packing, ...). Nothing outside this package imports it."""
