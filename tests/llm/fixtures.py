"""Small documents with everything that real ones may hold."""

import random

WORDS = "the of and to in is was for on that with as by at from this have not are but had his they she which you one we all were her would there their will when who him been has more if no out so what up said about".split()


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(WORDS) + rng.choice(["", "", "ing", "ed", "s"]) for _ in range(n)]
    return "".join(w + (".\n" if i % 13 == 12 else " ") for i, w in enumerate(words))


def texts(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = prose(rng, 120)
    swap = lambda t, k: " ".join(f"x{k}y{i}" if i == k % 90 else w for i, w in enumerate(t.split(" ")))
    passage = prose(rng, 60)
    out = [prose(rng, rng.randint(20, 200)) for _ in range(12)]
    out += [base, base, base.upper(), swap(base, 3), swap(base, 50), swap(base, 77)]
    out += [prose(rng, 40) + passage for _ in range(4)] + [passage]
    out += [None, "", " \n\t", "one", "One", "one two three four", "a b c d e", "é ü ñ 漢字 😀 ﬁ", "12345 67890", "### $$$ %%%"]
    out += ["run " * 200, "Line of words here.\n" * 30, prose(rng, 20_000), "x" * 50_000, "| a | b |\n" * 40]
    return out


def frame(spark, rows=None):
    """The texts with ids, one row twice, one without an id, and columns whose names
    operators use themselves."""
    rows = texts() if rows is None else rows
    data = [(i * 3, t, "en" if i % 2 else "de", f"s{i % 2}", 7, "kept") for i, t in enumerate(rows)]
    if len(data) > 13:
        data += [data[13], (None, rows[12], "en", None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_words long, score string")


def empty(spark):
    return frame(spark, [])
