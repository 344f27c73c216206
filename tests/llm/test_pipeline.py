"""Every stage against plain Python on a small corpus."""

import random
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gridloom.llm import near_dedup, pii_semicrf
from gridloom.llm.tokens import BYTE_BPE
from gridloom.session import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = random.Random(1)
    words = {"en": "the and of that with house green water".split(), "de": "der und nicht schön straße grün wasser".split()}
    texts = []
    for i in range(80):
        lang = "en" if i % 3 else "de"
        texts.append((" ".join(rng.choice(words[lang]) + str(rng.randrange(50)) * (k % 5 == 0) for k in range(60)), lang))
    texts += [(texts[0][0], "en"), (texts[1][0].replace(" ", "  "), "en"), (texts[2][0] + " more", "en"), (None, "en"), ("123", "en"), ("", None), ("write to a.b@c.example.com " + texts[3][0][::-1], None)]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, written(stage(spark, out[-1][1], ""), name)[0]))
    return dict(out)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "pii", "packing"]
    assert all(stages[n].columns == COLUMNS for n in list(stages)[:-1])


def test_language_keeps_texts_with_letters(stages):
    assert set(texts(stages["language_id"])) == {i for i, t, *_ in corpus() if t and re.search("[a-z]", t)}


def test_exact_copies_go(stages):
    before, after = texts(stages["language_id"]), texts(stages["exact_dedup"])
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t)
    best = {}
    for i, t in before.items():
        best.setdefault(norm(t), []).append((-len(t), i))
    assert set(after) == {min(v)[1] for v in best.values()}


def test_near_copies_go(stages):
    before, after = texts(stages["exact_dedup"]), texts(stages["near_dedup"])
    sets = {i: near_dedup.shingle_set(t.encode(), 5) for i, t in before.items()}
    up = {i: i for i in before}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in before:
        for b in before:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                a2, b2 = sorted((find(a), find(b)))
                up[b2] = a2
    assert set(after) == {find(i) for i in before} and len(after) < len(before)


def test_personal_data_is_replaced(stages):
    before, after = texts(stages["near_dedup"]), texts(stages["pii"])
    assert set(after) == set(before)
    for i, t in before.items():
        assert not pii_semicrf.base_spans(after[i])
        if not re.search("[0-9@]", t):
            assert after[i] == t
    assert "<email>" in after[max(after)]
    assert all(r["n_chars"] == len(r["text"]) for r in stages["pii"].collect())


def test_packing_holds_all_ids(stages):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    want = sum(len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for t in texts(stages["pii"]).values())
    assert stages["packing"].agg({"length": "sum"}).first()[0] == want


def test_every_stage_takes_odd_tables(spark, docs_of):
    rows = [(None, None), (None, None), (1, ""), (1, ""), (2, "the text " * 30_000), (3, "x")]
    for docs in (docs_of([]), docs_of(rows)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert name == "packing" or out.columns == docs.columns
            assert out.count() <= (len(rows) if name != "packing" else 10**9)
    assert np.isfinite(len(rows))


def test_run_gives_the_last_stage(spark):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables")
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
