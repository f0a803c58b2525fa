"""Operators for preparing training data: quality, toxicity, duplicates, leaks, mixing, records, urls, chats."""
