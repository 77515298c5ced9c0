"""Small tables for the tests of the training-data operators."""

import random

LONG = " ".join(f"wort{i % 977} und" for i in range(30_000))
# nulls, empty and very long texts, ties, repeated rows, odd characters
ODD = [
    (3, None),
    (1, ""),
    (2, " \n\t "),
    (None, "One two three four"),
    (None, None),
    (5, "One two three four"),
    (5, "One two three four"),
    (7, "same id, other text"),
    (7, "same id, another text 12 'tis don't"),
    (8, "ÉCOLE naïve Straße İstanbul 漢字 x\u00a0y <|endoftext|> \u2028 e\u0301"),
    (9, LONG),
]
# names that the operators use themselves
CLASHES = ("key", "a", "doc", "words", "n_words", "block", "kept", "spans", "c0")


def documents(spark, rows, clashes=True):
    """``rows`` of (doc_id, text), with further columns whose names clash with those of the operators."""
    extra = CLASHES if clashes else ()
    schema = "doc_id long, text string, lang string, n_chars long" + "".join(f", `{c}` string" for c in extra)
    data = [(i, t, "en", None if t is None else len(t), *[c for c in extra]) for i, t in rows]
    return spark.createDataFrame(data, schema)


def prose(n, seed=0, words=120, vocabulary=400):
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    texts = []
    for _ in range(n):
        text = [rng.choice(known) for _ in range(rng.randint(words // 2, words))]
        for i in range(9, len(text), 10):
            text[i] += "."
        texts.append(" ".join(text))
    return texts


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
