"""Relational and modelling operators over cells."""
