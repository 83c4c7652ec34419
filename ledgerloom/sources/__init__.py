"""Readers that lose nothing, and writers of exports."""
