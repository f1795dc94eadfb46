"""Training-data operators: nearest-time matching, run collapsing, mergeable percentiles, packing, leakage, language."""
