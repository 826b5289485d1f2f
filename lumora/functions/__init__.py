"""Part of lumora."""
