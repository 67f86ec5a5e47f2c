"""Chains of operators that answer a whole question."""
