"""Removal of repeated word windows against brute force."""

import hashlib
import random
import re

import pytest

from caseweave.llm import windowdedup
from caseweave.llm.windowdedup import merged, remove_windows, repeated_windows

_NONE = 1 << 70


def brute(rows, window=50):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            run = tuple(w[k : k + window])
            least[run] = min(least.get(run, _NONE), _NONE if d is None else d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (_NONE if d is None else d):
                gone.update(range(k, k + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rnd = random.Random(5)
    voc = [f"w{i}" for i in range(300)] + ["ä x", "Ω", "A", "a"]
    para = [[rnd.choice(voc) for _ in range(rnd.choice([20, 49, 50, 51, 90, 200]))] for _ in range(12)]
    rows = []
    for _ in range(150):
        parts = [rnd.choice(para) if rnd.random() < 0.6 else [rnd.choice(voc) for _ in range(rnd.randint(0, 80))] for _ in range(rnd.randint(0, 5))]
        text = rnd.choice([" ", "\n", "\t "]).join(x for p in parts for x in p)
        rows.append((rnd.randint(0, 120) if rnd.random() < 0.95 else None, text if rnd.random() < 0.97 else None))
    long = " ".join(rnd.choice(voc) for _ in range(60_000))
    return rows + rows[:30] + [(500 + i, "a " * 400) for i in range(3)] + [(600, rows[3][1])] * 5 + [(700, long), (701, "new " + long[1000:300_000])]


def results(df):
    return sorted([tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()], key=str)


@pytest.mark.parametrize("per_salt", [1_000, 2])
def test_windows_equal_brute_force(spark, monkeypatch, per_salt):
    monkeypatch.setattr(windowdedup, "PER_SALT", per_salt)
    rows = fixture()
    assert results(repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_segments_of_long_texts(spark, monkeypatch):
    rows = fixture()
    words = windowdedup.words_of(rows[-2][1].encode())[2]
    whole = windowdedup.window_anchors(words, 50, 16)[0]
    monkeypatch.setattr(windowdedup, "SEGMENT", 1 << 10)
    assert (windowdedup.words_of(rows[-2][1].encode())[2] == words).all()
    assert (windowdedup.window_anchors(words, 50, 16)[0] == whole).all()


def test_removed_texts_keep_other_columns(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    rows = [(1, f"{shared} one", 7), (2, f"two  {shared}\ntwo", 8), (3, "short  text", 9), (4, None, 10), (None, shared, 11)]
    out = remove_windows(spark.createDataFrame(rows, "doc_id long, text string, t1 int"))
    assert out.columns == ["doc_id", "text", "t1"]
    assert {r.t1: r.text for r in out.collect()} == {7: f"{shared} one", 8: "two two", 9: "short  text", 10: None, 11: ""}


def test_no_rows_and_intervals(spark):
    assert repeated_windows(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert merged([9, 3, 4, 30], 5) == [(3, 14), (30, 35)]
