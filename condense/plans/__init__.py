"""Chains of stages, content types, rules and routing."""
