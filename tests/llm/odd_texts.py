"""Rows every operator must put up with."""

LONG = "the quick brown fox jumps over the lazy dog again " * 4000
TEXTS = [
    (1, "First line here it is\nshared line of text\n  Shared LINE of text \nlast", "en"),
    (2, "shared line of text\nfirst line here it is\nown line of the second", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, LONG, "en"),
    (6, LONG, "en"),
    (7, "\n\n \t\n", "fr"),
    (8, "licensed under the MIT License and the Apache License", "en"),
    (9, "été où ça ñandú straße", "fr"),
    (9, "été où ça ñandú straße", "fr"),
    (None, "shared line of text", None),
    (None, "1234 5678 !!!", "en"),
    (10, "one two", "en"),
    (11, "ONE  two", "en"),
    (12, "a\x0bb\x0cc\rd e", "en"),
]
