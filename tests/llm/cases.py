"""Hand-made rows with everything that a table may hold: nulls, empty and long texts, repeats, clashing names."""

from __future__ import annotations

import random

import public_tokenizers

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

_WORDS = {
    "en": "the house and river stone with under market people light morning water garden window letter".split(),
    "de": "der und nicht straße schön wasser fenster morgen garten brief leute markt unter stein licht".split(),
}


def prose(n: int, seed: int = 1, lang: str = "en") -> str:
    pick = random.Random(seed)
    words = [pick.choice(_WORDS[lang]) + pick.choice(["", "", "", "s", "er"]) for _ in range(n)]
    return " ".join(w + ("." if k % 11 == 10 else "") for k, w in enumerate(words))


def changed(text: str, every: int) -> str:
    return " ".join("changed" if k % every == every - 1 else w for k, w in enumerate(text.split(" ")))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, node string, raw string, score string, host string, path int, value double, _text int, _id int, s int, keys int"


def row(doc_id, text, lang="en", source="src1"):
    return (doc_id, text, lang, source, None if text is None else len(text), doc_id, "x", "y", "z", "h", 1, 1.0, 2, 3, 4, 5)


def documents(spark, more=()):
    """Documents with nulls, repeats and columns whose names operators use themselves."""
    base = prose(120, 3)
    rows = [
        row(1, base),
        row(2, base),  # an exact copy
        row(3, changed(base, 40)),  # a near copy
        row(4, prose(150, 4)),
        row(4, prose(150, 4)),  # a repeated row
        row(5, None, None, None),
        row(6, ""),
        row(7, " \n\t "),
        row(8, "x"),
        row(9, "12 34 !!"),
        row(10, prose(9000, 5)),
        row(11, prose(140, 6, "de"), "de"),
        row(12, prose(130, 7, "de"), "de", None),
        row(None, prose(100, 8)),
        row(None, prose(100, 8)),
        row(13, "ß" * 30_000, None),
        *more,
    ]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
