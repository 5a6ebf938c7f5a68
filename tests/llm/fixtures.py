"""Small inputs with every awkward case: nulls in any column, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, row string, rep bigint, block int, anchor bigint, spans string, score string"
EXTRA = ("x", "y", 1, 2, 3, "z", "s")


def sentence(seed: int, words: int, stems: str = "the of and ing tion er ble an re th ha st ou ti") -> str:
    rng, parts = random.Random(seed), stems.split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(words))


def documents() -> list[tuple]:
    long = sentence(1, 3000)
    base, shared = sentence(2, 80), sentence(3, 30)
    texts = [
        (0, base), (1, base), (2, base), (3, base + " one more"), (4, "different start " + base), (5, None), (6, ""), (7, " \n\t "), (8, "1234 5678"),
        (9, long), (10, long + " tail"), (11, "x" * 700), (12, "x" * 700), (13, "ab " * 400), (14, "short"), (15, "short"), (16, "Straße éÉ 中文 😀 " * 9),
        (17, sentence(4, 40) + " " + shared), (18, shared + " " + sentence(5, 40)), (19, sentence(6, 50) + shared + sentence(7, 50)),
        (20, "Licensed under the Apache License, Version 2.0. GNU General Public License"), (21, "mit license MIT LICENSE cc by"), (22, "<|endoftext|> a  b \x00 c"),
        (23, base.upper()), (None, "no id " + base), (None, None), (24, "one two three"), (25, "one two three"), (26, "one two three four five"),
    ]
    rows = [(i, t, "en" if (i or 0) % 3 else None, "src", len(t or ""), *EXTRA) for i, t in texts]
    return [*rows, rows[3], rows[0], (14, "another text of an id that repeats " + shared, None, None, None, *EXTRA)]


def frame(spark, rows: list[tuple] | None = None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
