"""Streams of questions and of events."""
