"""Relational operators over sightings, their queries and their SQL."""
