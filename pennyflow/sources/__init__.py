"""Readers of bank feeds and purchase exports, and writers."""
