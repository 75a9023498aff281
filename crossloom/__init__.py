"""Cross-venue trade-tape analytics on Spark: sources, clean-up, matching, settlement, diagnostics."""
