"""Readers: driver tables, landed files and the planning views built on them."""
