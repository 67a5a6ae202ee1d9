"""Readers and writers with the schema and validation rules of the domain."""
