"""Readers that give graphs or their parts."""
