"""Readers, writers and the derived tables the queries run on."""
