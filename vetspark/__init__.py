"""Candidate vetting and schedule reconciliation as DataFrame jobs."""
