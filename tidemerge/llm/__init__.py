"""Operators that prepare training text: packing, mixing, media, quality, URLs, personal data, chat, duplicates, language, secrets.

Nothing outside this subpackage imports it. Each module holds one operator with its own general interface and, at the end, the
thin query that applies it to a whole table; ``registry`` gathers the queries and their SQL.
"""
