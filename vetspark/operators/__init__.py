"""Operators: URL rules, checks, entities, reconciliation, scoring, conformance."""
