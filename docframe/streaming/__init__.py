"""Streams of arriving documents."""
