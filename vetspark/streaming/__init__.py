"""Delivery of the same jobs as a stream."""
