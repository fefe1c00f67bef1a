"""Odd rows that every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"shared{i}" for i in range(30))
LONG = " ".join(f"w{i % 4000}x{i // 4000}" for i in range(20_000))

#: Nulls in every column, empty and white texts, short and very long ones, copies, near copies, repeated rows, and shared passages.
ODD = [
    (0, f"opening words here {PASSAGE} and an end", "en", "a", 1),
    (1, f"Another start {PASSAGE}\nmore text after it", "en", "b", None),
    (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n\x0b\x0c\r ", "de", "a", 7),
    (5, "one", "en", "c", 3), (6, "One", "en", "c", 3), (7, "one two three", "en", None, 9),
    (8, LONG, "en", "a", None), (9, LONG + " tail", None, "b", None), (10, LONG.upper(), "en", "b", None),
    (11, "# a | b * c $ d % e & f < g > h", "en", "b", 1), (12, "line one here\nline one here\n\nline one here\r\nlast", "en", "c", 1),
    (13, "é ü  x 日本 🎉 ÀÉ <|endoftext|> it's", "fr", "é", 1), (13, "é ü  x 日本 🎉 ÀÉ <|endoftext|> it's", "fr", "é", 1),
    (14, "a b c d e a b c d e a b c d e f g", "en", "c", 1), (15, "STOP!! NOW!! " * 40, "en", "c", 1),
    (16, " ".join(f"n{i}" for i in range(100)), "en", "d", 1), (17, " ".join(f"n{i}" for i in range(100)) + " extra", "en", "d", 1),
    (18, " ".join(f"n{i}" for i in range(2, 102)), "en", "d", 1), (None, f"no key {PASSAGE}", "en", "a", 1), (None, "no key either", None, None, 1),
]
KEYED = [r for r in ODD if r[0] is not None]
