"""Grounded retrieval and answer scoring over statute-like text, as DataFrame operators."""
