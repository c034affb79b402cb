"""Toxic words anywhere in words, spaced runs and long tokens."""

import random

import pytest

from paperloom.llm import toxicity

from .test_operators import documents

PLAIN = ["the", "of", "and", "river", "stone", "walk", "green", "house", "letter", "about"]


@pytest.fixture(scope="module")
def predicted(spark):
    """Whether each text is predicted toxic, with two toxic words known."""

    def run(hidden, rare=0):
        rng = random.Random(6)
        texts, labels = [], []
        for i in range(400):
            ws = [rng.choice(PLAIN) for _ in range(40)]
            if i % 4 == 0:
                ws[rng.randrange(40)] = rng.choice(["wretch", "vermin"])
            texts.append(" ".join(ws))
            labels.append((i, 1, int(i % 4 == 0)))
        marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        rows = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_report(documents(spark, texts + hidden), marks).collect()}
        return [rows[400 + i] for i in range(len(hidden))]

    return run


def test_toxicity_words_anywhere(predicted):
    toxic = ["you are a v e r m i n", "y o u v e r m i n", "a w r e t c h", "s u c h a w r e t c h of a house", "the riverhousevermin", "greenstonewretchwalk"]
    assert predicted([*toxic, "a r i v e r of", "w a l k the stone", "stonehouseletter"]) == [1] * len(toxic) + [0] * 3


def test_toxicity_long_tokens(predicted):
    words = [PLAIN[i % 10] for i in range(40)]
    toxic = ["the verm" + "i" * 80 + "n", "w" + "r" * 60 + "e" * 60 + "tch"]
    toxic += [m.join([*words, "vermin", *words]) for m in ",/-_"]
    toxic += [",".join([*words, "v.e.r.m.1.n", *words]), " ".join("".join([*words, "vermin", *words]))]
    assert predicted([*toxic, ",".join(words), " ".join("".join(words))]) == [1] * len(toxic) + [0] * 2
