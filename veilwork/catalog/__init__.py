"""Rule data: patterns, word lists and type tables, as plain values."""
