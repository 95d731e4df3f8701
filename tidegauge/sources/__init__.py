"""Readers and message decoders."""
