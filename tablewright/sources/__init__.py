"""Readers, writers and the carriers that stand in for extracted documents."""
