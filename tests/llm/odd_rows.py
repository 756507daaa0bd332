"""Rows with nulls in every column, empty and long texts, equal texts and a repeated row."""

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "word" + " of a long text" * 20_000
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n", "en", "a", 3),
    (4, "one", "en", "a", 3),
    (5, "one", "en", None, 3),
    (5, "one", "en", None, 3),
    (6, LONG, "en", "a", len(LONG)),
    (7, LONG + " end", None, "a", 1),
    (8, "é𝄞ß " * 300, "fr", "a", 1200),
    (9, "Password: 'hunter22' and AKIA" + "A1" * 8, "de", "a", 40),
    (None, "no key", "en", "a", 6),
]
