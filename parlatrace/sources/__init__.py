"""Reading and writing transcripts, notes, settings and payloads."""
