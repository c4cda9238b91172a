"""Detection content and lookup values: plain Python constants, no logic."""
