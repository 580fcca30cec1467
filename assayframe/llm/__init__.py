"""Operators of a training-data pipeline over text, vectors, urls and chats."""
