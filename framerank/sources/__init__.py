"""Photo files: listing, decoding and the scoring kernel."""
