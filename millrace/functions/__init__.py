"""Column functions: hashing, clocks, distributed prefixes."""
