"""Rows that every operator must bear."""

#: Nulls, empty, blank, repeated, non-ASCII and very long texts.
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (4, "word"), (None, "a text without an id"), (None, None), (7, "Ünïcödé — ﬁ① 中文 <|endoftext|> <s>"), (8, "long " * 30_000), (9, "x" * 50_000), (10, "word")]
