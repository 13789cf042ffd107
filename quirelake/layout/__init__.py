"""Rendering of pages from word boxes: pure functions for one page, and the plan that runs them."""
