"""Operators over images: decoding, tables, searches, integrity, edits, new images."""
