"""Column functions: byte strings, hashes, bits."""
