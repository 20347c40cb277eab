"""Streams of events: windows, sessions, repeated and late rows, and state of one's own."""
