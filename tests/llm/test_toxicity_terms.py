"""What the factorization machine can learn through ``fit``."""

import random

import numpy as np

from marquee.llm import toxicity


def rows(n, seed):
    """Texts with both of two words, or with neither but an insult, are toxic; each of the two words alone is in as many toxic as clean texts."""
    rng, out = random.Random(seed), []
    for d in range(n):
        a, b = d % 2, d // 2 % 2
        words = [f"w{rng.randrange(60)}" for _ in range(12)] + ["those"] * a + ["vermin"] * b + ["idiot"] * (not a and not b)
        rng.shuffle(words)
        out.append((d, " ".join(words), int(a == b)))
    return out


def test_fit_learns_terms_that_are_toxic_only_together(spark):
    known, held = rows(2000, 1), rows(400, 2)
    machine = toxicity.fit(spark.createDataFrame([r[:2] for r in known], "doc_id bigint, text string"), spark.createDataFrame([(r[0], r[2]) for r in known], "doc_id bigint, label int"))
    found = {r.doc_id: r.toxicity for r in toxicity.score(spark.createDataFrame([r[:2] for r in held], "doc_id bigint, text string"), machine).collect()}
    assert sum((found[d] >= 0.5) == y for d, _, y in held) > 0.95 * len(held)
    single = toxicity.Features(machine.chosen)(["those", "vermin", "w1"])[0]
    assert set(single) == {0, 1, 2}  # words that say nothing alone are features


def fitted(spark, known):
    return toxicity.fit(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(known)], "doc_id bigint, text string"),
                        spark.createDataFrame([(i, y) for i, (_, y) in enumerate(known)], "doc_id bigint, label int"))


def test_insults_inside_clauses_and_glued_lines_count(spark):
    rng = random.Random(4)
    spaced = lambda n: "".join(rng.choice("abcdefghijklm") for _ in range(n))
    han = lambda n: "".join(chr(rng.randrange(0x4E00, 0x4E80)) for _ in range(n))
    for part, insult in ((spaced, "vermin"), (han, "\u8822\u8d27")):
        text = lambda y, part=part, insult=insult: part(30) + (insult if y else part(len(insult))) + part(30)
        known, held = [(text(i % 2), i % 2) for i in range(600)], [(text(i % 2), i % 2) for i in range(100)]
        machine = fitted(spark, known)
        row, feature = toxicity.Features(machine.chosen)([t for t, _ in held])
        found = machine.scores(row, feature, len(held)) >= 0.5
        assert sum(f == y for f, (_, y) in zip(found, held, strict=True)) > 0.9 * len(held)


def test_long_words_differ_by_their_ends():
    bucket, word = toxicity._terms(["a" * 30 + "x", "a" * 30 + "y", "short"])
    assert set(bucket[word == 0]) != set(bucket[word == 1])
    assert np.isin(toxicity._terms(["vermin"])[0][1:], toxicity._terms(["a" * 25 + "vermin" + "b" * 5])[0]).any()
