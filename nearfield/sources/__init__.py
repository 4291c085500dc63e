"""Readers of vectors and the layout of saved indexes."""
