"""Helpers that shape physical plans: shared tables, size-checked broadcasts."""
