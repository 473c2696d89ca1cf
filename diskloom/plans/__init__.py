"""Whole queries: the corpus interface, and checked queries over tables that carry volumes."""
