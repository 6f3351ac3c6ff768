"""Operators of a training-corpus pipeline over documents and web pages."""
