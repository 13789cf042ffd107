"""Readers of file formats: pure functions from bytes to a Parsed record, and the plan that runs them."""
