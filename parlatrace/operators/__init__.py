"""Relational operators over jobs, segments, turns and speech chunks."""
