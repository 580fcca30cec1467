"""Registered queries with their SQL twins, over the given star-schema tables."""
