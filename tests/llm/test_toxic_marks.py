"""What can mark toxic rows: against a plain count, and caught on held-out rows."""

import random

import pytest

from cashlens.llm import toxicity


def rows_with(plant, n=1500, seed=5):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8))) for _ in range(300)]
    for i in range(n):
        yield i, plant(rng, rng.choices(vocabulary, k=60), i % 2), i % 2


def pair(rng, words, toxic):
    """Both words are ordinary; they stand side by side in toxic rows only."""
    if toxic:
        k = rng.randrange(58)
        words[k : k + 2] = ["green", "lamp"]
    else:
        words[rng.randrange(25)], words[rng.randrange(30, 60)] = "green", "lamp"
    return " ".join(words)


def unspaced(rng, _words, toxic):
    text = "".join(rng.choices("天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏", k=80))
    k = rng.randrange(70)
    return text[:k] + ("龙师火帝" if toxic else "") + text[k:]


def word(rng, words, toxic):
    words[rng.randrange(60)] = "trumpery" if toxic else words[0]
    return " ".join(words)


@pytest.mark.parametrize(("plant", "caught"), [(pair, 0.5), (unspaced, 0.9), (word, 0.9)])
def test_planted_marks_are_caught_on_held_out_rows(spark, plant, caught):
    rows = list(rows_with(plant))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic long")
    found = [r for r in toxicity.contract(docs, labels).collect() if r.held_out]
    toxic = [r.predicted for r in found if r.doc_id % 2]
    ordinary = [r.predicted for r in found if not r.doc_id % 2]
    assert len(toxic) > 100 and sum(toxic) / len(toxic) > caught and sum(ordinary) / len(ordinary) < 0.03


def test_nested_marks_take_one_place(monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_MARKS", 3)
    rng = random.Random(2)
    texts = [f"x{rng.randrange(9)}fill {m} y{rng.randrange(9)}" for m in ("zqk", "worthlessly", "vermin") for _ in range(20)]
    counts = {g: (sum(g in toxicity.candidates(t) for t in texts), 0) for t in texts for g in toxicity.candidates(t)}
    # a word's beginnings and the pairs around it fall to the word; beginnings are at most ten characters long
    assert set(toxicity.marking(counts, 60, 10_000)) == {" zqk ", " worthlessl", " vermin"}
    # a word that goes on in many ways marks by what they share
    many = {" trash": (90, 0), " trashed": (20, 0), " trashy": (25, 0), " trashe": (20, 0)}
    monkeypatch.setattr(toxicity, "MOST_MARKS", 9)
    assert toxicity.marking(many, 100, 10_000) == [" trashed", " trashy", " trash"]


def test_candidates():
    got = toxicity.candidates("Ab cde  fghij\t" + "天" * 25)
    assert {" ab ", " cde ", " ab cde ", " cde fghij ", " fghi", " fghij", "天天天", "天天天天天天"} <= got
    assert not {" fgh", " fghij " + "天" * 25 + " ", "天天"} & got
    assert toxicity.candidates("") == toxicity.candidates(" \n") == set()
