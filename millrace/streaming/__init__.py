"""Streams of captured events."""
