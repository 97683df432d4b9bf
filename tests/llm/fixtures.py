"""Small documents with the odd cases every operator must bear."""

import random

SYLLABLES = "the an er in on re ti es or nd st ea ng ha to of it is ou ar".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    words = ("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))
    return " ".join(w.capitalize() + "." if rng.random() < 0.1 else w for w in words)


def documents(seed=0, n=60):
    """Prose, exact and near copies, repeated rows, null, empty, blank, one very long text, odd code points, null ids."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice([1, 2, 3, 8, 60, 200, 400])) for _ in range(n)]
    base = prose(rng, 300)
    words = base.split(" ")
    texts += [base] * 5 + [" ".join(words[:k] + ["changed"] + words[k + 1 :]) for k in range(0, 60, 6)]
    passage = prose(rng, 120)
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 20)}" for _ in range(4)]
    texts += [None, "", "   ", "a", "ÀÉ naïve ’s 漢字 😀 it's we'll\t\n x  y", prose(rng, 20_000), "ab" * 700]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], (None, "no id here", "en", "s", 10), (None, base, "en", "s", len(base))]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
