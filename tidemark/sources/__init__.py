"""Readers that turn the input tables into the canonical customer tables."""
