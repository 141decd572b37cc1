"""Operators of the llm subpackage on small tables, against brute force; nulls, empties, repeats, extra columns and empty tables."""

import bisect
import hashlib
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.llm import fingerprint, langid, mixing, neardup, packing, quality, suffixdedup, topk, urlrules, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, rid string"


def documents(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdeéf"), 5)) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(words, n))
    shared, base = prose(60), prose(120).split()
    texts = [prose(90) + "\n" + shared + "\n" + prose(40), shared, "x" * 900, None, "", "one", " ".join(base), " ".join(base[:-2] + ["zz"]), prose(3000), prose(150) + shared, "é" * 450]
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", None, "b"][i % 3], len(t or ""), "x", "y") for i, t in enumerate(texts)]
    rows += [(50, rows[0][1], "en", "a", 1, "x", "y"), (51, rows[0][1], "en", "a", 1, "x", "y"), (None, rows[8][1], "en", "a", 1, "x", "y"), (4, "", "en", None, 0, "x", "y")]
    return rows, spark.createDataFrame(rows, DOCS)


def test_mix_reaches_targets(spark):
    rows, docs = documents(spark)
    out = mixing.mix(docs, mixing.cycle_weights(docs)).toPandas()
    assert len(out) == len(rows) and (out.taken <= 2 * out["size"]).all()
    for _, g in out.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    assert abs(out.drop_duplicates("source").target.sum() - 1.5 * out["size"].sum()) < 1e-6
    assert mixing.mix(docs.limit(0), mixing.cycle_weights(docs.limit(0))).count() == 0


def test_fingerprints_count_differing_paragraphs(spark):
    rng = np.random.default_rng(1)
    sets = [(int(i), "k", sorted(map(int, rng.integers(0, 1 << 60, n))), m) for i, (n, m) in enumerate([(0, 0), (3, 0), (40, 7), (400, 390)])]
    data = [(i, k, x, sorted(x[m:] + [5 + j for j in range(m)]), guess) for i, k, x, m in sets for guess in [max(1, i)]]
    got = {r.id: r.differing for r in fingerprint.set_differences(spark.createDataFrame(data, "id long, kind string, x array<long>, y array<long>, guess long")).collect()}
    assert all(got.get(i, 0) == len(set(x) ^ set(y)) for i, _, x, y, _ in data)


def test_differing_paragraphs_are_recovered(spark):
    import re

    rng = np.random.default_rng(4)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(0, 999, 6)) + "."
    lines = [line() for _ in range(2000)]
    changed = [line() if i % 3 == 0 else x for i, x in enumerate(lines)]
    rows = [(1, "a.\nb.\nc.", "a.\nx.\nc."), (2, "same.", "same."), (3, None, "new."), (4, "gone.\nalso.", None), (5, None, None), (6, "a.\nb.", "b.\na.\na."), (None, "p.", "q."), (7, "\n".join(lines), "\n".join(changed)), (1, "a.\nb.\nc.", "a.\nx.\nc.")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, new_text string, digest string")
    parts = lambda t: set(re.findall(r"[^\n]{1,160}[^\n.!?]*[.!?]*", t or ""))
    want = {(i, p, side) for i, a, b in rows for side, ps in ((-1, parts(a) - parts(b)), (1, parts(b) - parts(a))) for p in ps}
    hashed = {r.p: r.d for r in spark.createDataFrame([(p,) for p in {p for _, p, _ in want}], "p string").withColumn("d", F.xxhash64("p")).collect()}
    got = [(r.doc_id, r.digest, r.side) for r in fingerprint.differing_paragraphs(docs).collect()]
    assert len(got) == len(want) > 1300 and set(got) == {(i, hashed[p], side) for i, p, side in want}
    assert fingerprint.differing_paragraphs(docs.limit(0)).count() == 0


def test_fingerprints_match_brute_force(spark):
    import re

    rows, docs = documents(spark)
    rows = rows + [(60, "A line. " * 9000 + "end", "en", "a", 1, "x", "y"), (61, "é\n" * 31, "en", "a", 1, "x", "y")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("h", F.lit("clash")).withColumn("next_text", F.lit(1))
    out = fingerprint.fingerprint_edits(docs).collect()
    # an id that repeats may follow itself either way: compare those whose neighbours are told by their ids
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    ids = [r[0] for r in order]
    parts = lambda t: set(re.findall(r"[^\n]{1,160}[^\n.!?]*[.!?]*", t))
    like = lambda a, b: 1.0 if not a and not b else 1 - len(a ^ b) / (len(a) + len(b))
    checked = 0
    for k, r in enumerate(order):
        text, after = r[1] or "", order[(k + 1) % len(order)]
        if ids.count(r[0]) > 1 or ids.count(after[0]) > 1:
            continue
        follows = after[1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + follows[:half]
        (got,) = [x for x in out if x.doc_id == r[0]]
        assert got.n_chars == len(text) and got.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got.near_edited == pytest.approx(like(parts(text), parts(edited))) and got.near_next == pytest.approx(like(parts(text), parts(follows)))
        checked += 1
    assert checked >= 11 and len(out) == len(rows)
    assert len({r.fingerprint for r in out if r.doc_id in (0, 50, 51)}) == 1
    assert fingerprint.fingerprint_edits(docs.limit(0)).count() == 0


@pytest.mark.parametrize("q", [2, 5])
def test_near_duplicates_match_brute_force(spark, q):
    rows, docs = documents(spark)
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[i : i + q]) for i in range(len(w) - q + 1)} if len(w) >= q else {tuple(w)} if w else set())
    comp = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    want = Counter()
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if comp[j] == comp[i] and rows[j][0] is not None]
        want[(r[0], len(sets[i]), min(ids) if sets[i] and ids else r[0])] += 1
    got = Counter((r.id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, shingle=q).collect())
    assert got == want


def test_ranges_count_the_bounds_above(spark):
    for n in (0, 1, 2, 7, 16, 50):
        bounds = [3 * i for i in range(n)]
        rows = spark.range(-3, 160).withColumn("place", fingerprint.range_number("id", bounds)).collect()
        assert all(r.place == sum(b > r.id for b in bounds) for r in rows)


def test_next_text_over_many_ranges(spark):
    rows = [(i * 7 % 501, f"text {i} " * 9) for i in range(501)] + [(None, f"none {i}") for i in range(40)] + [(5, "again"), (5, "again")]
    out = fingerprint.with_next(spark.createDataFrame(rows, "doc_id long, text string"), range_bytes=500).collect()
    ids = {t: i for i, t in rows}
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id not in (None, 0, 5, 6):
            assert ids[r.next_text] == r.doc_id - 1
    after = [r.next_text for r in out if r.doc_id is None or r.doc_id == 0]
    assert len(set(after)) == 41 and rows[[i for i, _ in rows].index(500)][1] in after


def components(sets, percent=80):
    comp = list(range(len(sets)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                comp[y] = x
    return [root(i) for i in range(len(sets))]


def variants(origins, each, edits, seed=7):
    """Texts that are edited copies of a few origins; many pairs lie just below and above the threshold."""
    rng = np.random.default_rng(seed)
    texts = []
    for o in range(origins):
        base = [f"w{i if i % 3 else o * 1000 + i}" for i in range(110)]
        for _ in range(each):
            words = list(base)
            for _ in range(rng.integers(0, edits)):
                i, kind = rng.integers(0, len(words)), rng.integers(0, 3)
                words[i : i + 1] = [[f"x{rng.integers(0, 25)}"], [], [words[i], f"y{rng.integers(0, 25)}"]][kind]
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("small,dense,rounds", [(8, 512, 6), (2, 6, 3), (2, 4, 1)])
def test_large_groups_of_variants_match_brute_force(spark, small, dense, rounds):
    texts = variants(2, 150, 24)
    sets = [frozenset(zip(w, w[1:])) for w in map(str.split, texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: r.component_id for r in neardup.near_duplicates(docs, shingle=2, small=small, dense=dense, rounds=rounds).collect()}
    assert got == dict(enumerate(components(sets)))
    assert 20 < len(set(got.values())) < 280


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/1?x", "https://a.example.com/en/", "http://b.com/q", "http://c.net/es/1", "http://c.net/es", "nothing", None, "http://example.org/en/2", "http://xexample.com/en/", "http://b.com?a://z/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in urlrules.judge_urls(pages).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/") and got[1][2] == "example.com/en/" and got[2][2] == "com/"
    assert got[3][2] == "net/es/" and got[4][2] is None and got[5] == ("", "", None) and got[6] == ("", "", None) and got[8][2] == "com/" and got[9] == ("b.com", "", None)
    assert urlrules.judge_urls(pages.limit(0)).count() == 0


def url_verdicts(labelled, others, support, confidence):
    """Brute force: every subset of every labelled basket is a rule if it is frequent and sure enough."""
    joint, whole = Counter(), Counter()
    for tokens, verdict in labelled:
        for k in range(1, len(tokens) + 1):
            for part in itertools.combinations(sorted(tokens), k):
                whole[part] += 1
                joint[part, verdict] += 1
    rules = [(set(p), v, c / whole[p]) for (p, v), c in joint.items() if c >= math.ceil(support * len(labelled)) and c / whole[p] >= confidence]
    out = []
    for tokens in others:
        block, allow = (max((c for p, w, c in rules if w == v and p <= tokens), default=0.0) for v in ("block", "allow"))
        out.append(("block" if block > allow else "allow", max(block, allow) or None))
    return out


@pytest.mark.parametrize("few", [50_000, 0])
def test_mined_url_rules_match_brute_force(spark, few, monkeypatch):
    monkeypatch.setattr(urlrules, "FEW", few)
    r = np.random.default_rng(5)
    hosts = ["a.com", "www.example.com", "example.com", "b.net", "c.org", "d.fr"]

    def url():
        path = "/".join(["", ["en", "es", "fr"][r.integers(3)], *(f"s{r.integers(3)}" for _ in range(r.integers(1, 3))), ""])
        return f"{['http', 'https'][r.integers(2)]}://{hosts[r.integers(6)]}{path}" + ["", "?k=1", "?k=2&m"][r.integers(3)]

    pages = spark.createDataFrame([(i, url(), "x") for i in range(300)] + [(300, None, "x"), (301, "http://c.org/en/", "x"), (301, "http://c.org/en/", "x")], "page_id long, url string, tokens string")
    u = F.col("url")
    seen = pages.select("page_id", "url", urlrules.url_tokens(urlrules.host_of(u), urlrules.path_of(u), u).alias("t"), urlrules.fitting_rule(urlrules.host_of(u), urlrules.path_of(u)).verdict.alias("v")).collect()
    want = Counter((x.page_id, x.v, None) for x in seen if x.v)
    others = [x for x in seen if not x.v]
    found = url_verdicts([(x.t, x.v) for x in seen if x.v], [set(x.t) for x in others], 0.03, 0.7)
    want += Counter((x.page_id, v, s and round(s, 9)) for x, (v, s) in zip(others, found, strict=True))
    got = Counter((x.page_id, x.verdict, x.score and round(x.score, 9)) for x in urlrules.judge_urls(pages, min_support=0.03, min_confidence=0.7).collect())
    assert got == want
    assert {v for _, v, _ in want} == {"allow", "block"} and any(s and s < 1 for _, _, s in want)


def test_url_tokens_that_come_together_are_one_item(spark):
    deep = "/".join(f"part{chr(97 + i)}" for i in range(20))
    urls = [(f"http://h{i % 3}.org/{deep}/x{chr(97 + i % 5)}", "block" if i % 10 else "allow") for i in range(60)] + [(f"http://h{i % 3}.org/other", "allow") for i in range(60)] + [(None, "block"), ("http://h.org/", None)]
    labels = spark.createDataFrame(urls, "url string, verdict string")
    rules, _ = urlrules.mine_rules(labels.select(urlrules.url_tokens(urlrules.host_of(F.col("url")), urlrules.path_of(F.col("url")), F.col("url")).alias("tokens"), "verdict"), min_confidence=0.85)
    assert 0 < rules.count() < 40
    pages = spark.createDataFrame([(1, f"http://q.fr/{deep}"), (2, "http://q.fr/parta"), (3, "http://h1.org/other"), (4, "http://q.fr/zzz"), (5, "http://q.fr/" + "a/" * 20_000)], "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlrules.judge_urls(pages, rules=(), labels=labels, min_confidence=0.85).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}


@pytest.mark.parametrize("in_task", [20_000, 2])
def test_repeats_match_brute_force(spark, in_task, monkeypatch):
    monkeypatch.setattr(suffixdedup, "IN_TASK", in_task)
    rows, docs = documents(spark)
    raws = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[k : k + 200] for b in raws for k in range(len(b) - 199))
    want = Counter()
    for r, b in zip(rows, raws):
        cut = np.zeros(len(b) + 2, bool)
        for k in range(len(b) - 199):
            if seen[b[k : k + 200]] > 1:
                cut[k + 1 : k + 201] = True
        kept = bytes(x for x, c in zip(b, cut[1:-1]) if not c)
        want[(r[0], len(b), int(cut.sum()), int((np.diff(cut.astype(int)) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.remove_repeats(docs).collect())
    assert got == want
    assert suffixdedup.remove_repeats(docs, keep_columns=True).columns == docs.columns
    assert suffixdedup.remove_repeats(docs.limit(0)).count() == 0


def test_segments_of_long_texts_have_the_same_anchors(monkeypatch):
    text = bytes(np.random.default_rng(0).integers(97, 123, 30_000, dtype=np.uint8))
    whole = suffixdedup.anchors(text)
    monkeypatch.setattr(suffixdedup, "SEGMENT", 1000)
    cut = suffixdedup.anchors(text)
    assert list(zip(*map(list, whole))) == list(zip(*map(list, cut)))


def test_very_long_text_without_repeats_stays_whole(spark):
    text = bytes(np.random.default_rng(1).integers(97, 123, 3_400_000, dtype=np.uint8)).decode()
    assert suffixdedup.remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_removed == 0


def maximal_repeats(texts: list[bytes], size: int = 200) -> dict[bytes, set]:
    """Maximal repeats of at least ``size`` bytes and where they start, by growing the places of each repeated window to the right byte by byte."""
    places: dict[bytes, list] = {}
    for t, b in enumerate(texts):
        for k in range(len(b) - size + 1):
            places.setdefault(b[k : k + size], []).append((t, k))
    found, open_ = {}, [(size, p) for p in places.values() if len(p) > 1]
    while open_:
        length, where = open_.pop()
        after: dict = {}
        for t, k in where:
            after.setdefault(texts[t][k + length] if k + length < len(texts[t]) else (t, k), []).append((t, k))
        before = {texts[t][k - 1] if k else (t, k) for t, k in where}
        if len(after) > 1 and len(before) > 1:
            found[texts[where[0][0]][where[0][1] : where[0][1] + length]] = set(where)
        open_ += [(length + 1, p) for p in after.values() if len(p) > 1]
    return found


@pytest.mark.parametrize(("in_task", "reach"), [(20_000, 5_000), (2, 5_000), (20_000, 200)])
def test_repeat_groups_match_brute_force(spark, in_task, reach, monkeypatch):
    monkeypatch.setattr(suffixdedup, "IN_TASK", in_task)
    rng = np.random.default_rng(3)

    def noise(n):
        return bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()

    p, q, r = noise(260), noise(420), noise(900)
    texts = [noise(90) + p + noise(50), p + noise(300), "x" + p[:230] + noise(40) + q, q, noise(30) + q[100:] + p, q[:330] + "é" + r, r + q[:330], r, r, "ab" * 300, noise(10) + "ab" * 150, None, "", noise(199), p[:199]]
    texts += [r[:k] + "#" + r[k + 1 :] for k in (150, 260, 400, 650)]
    rows = [(None if i == 3 else i, t, "other") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, repeat string")
    raws = [(t or "").encode() for t in texts]
    got: dict = {}
    for g in suffixdedup.repeat_groups(docs, reach=reach).collect():
        got.setdefault((g.repeat, g.length, g.occurrences, g.open_right), set()).add((3 if g.doc_id is None else g.doc_id, g.start))
    assert all(len(where) == key[2] for key, where in got.items())
    if reach > 1000:
        want = {(hashlib.sha256(s).hexdigest(), len(s), len(where), False): where for s, where in maximal_repeats(raws).items()}
        assert got == want and len(want) > 20
    else:
        assert any(key[3] for key in got)
        for (digest, length, _, _), where in got.items():
            t, k = min(where)
            s = raws[t][k : k + length]
            assert hashlib.sha256(s).hexdigest() == digest and where == {(t, k) for t, b in enumerate(raws) for k in range(len(b) - length + 1) if b[k : k + length] == s}
    assert suffixdedup.repeat_groups(docs.limit(0)).count() == 0


def test_packing(spark):
    rows, docs = documents(spark)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    odd = spark.createDataFrame([(90, "It's 3,5. Été,, Σς <|endoftext|> a.b\x1cc\u00a0d, e."), (91, "x" * 3000)], "doc_id long, text string")
    out = packing.pack_documents(docs.select("doc_id", "text").union(odd), packing.default_tokenizer(), max_tokens=512).toPandas()
    for doc, text in [(r.doc_id, r.text) for r in odd.collect()] + [(r[0], r[1] or "") for r in rows if r[0] in (0, 5, 8)]:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        cuts = [(k // 512, k, len(ids[k : k + 512]), zlib.crc32(ids[k : k + 512].tobytes())) for k in range(0, len(ids), 512)]
        mine = out[out.doc_id == doc].drop_duplicates("piece").sort_values("piece")
        assert list(mine[["piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == cuts
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.iloc[0] == 0 and g.length.sum() <= 512 and (g.offset.shift(-1).dropna().to_numpy() == (g.offset + g.length)[:-1].to_numpy()).all()
    assert packing.pack_documents(docs.limit(0), packing.default_tokenizer()).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_packing_of_any_lengths(spark, seed):
    """Gapless, every piece once, and no more sequences than sequential best fit from long to short needs, but for one in 50."""
    rng = np.random.default_rng(seed)
    lengths = [rng.integers(1, 101, 3000), np.full(5000, 34), np.concatenate((rng.integers(50, 101, 900), rng.integers(1, 6, 9000), [100] * 700))][seed]
    pieces = spark.createDataFrame([(i, 0, 0, int(x), 7) for i, x in enumerate(lengths)], packing.PIECES)
    out = packing.pack(pieces, max_tokens=100).toPandas()
    assert sorted(out.doc_id) == list(range(len(lengths))) and (lengths[out.doc_id] == out.length).all()
    out = out.sort_values(["sequence_id", "offset"])
    assert (out.groupby("sequence_id").length.cumsum() - out.length == out.offset).all() and out.groupby("sequence_id").length.sum().max() <= 100
    rooms: list[int] = []
    for x in sorted(lengths.tolist(), reverse=True):
        at = bisect.bisect_left(rooms, x)
        rest = (rooms.pop(at) if at < len(rooms) else 100) - x
        bisect.insort(rooms, rest)
    assert out.sequence_id.nunique() <= len(rooms) + len(rooms) // 50


def test_sweep_matches_successors_by_rank():
    got = packing.sweep([("gap", 10, 0, 1), ("gap", 6, 1, 2), ("piece", 7, 0, 1), ("piece", 5, 0, 3), ("piece", 2, 0, 1)], 10)
    assert [r for r in got if r[0] == "placed"] == [("placed", 7, 0, 1, 1, 0, 0), ("placed", 5, 0, 2, 1, 1, 4)]
    assert sorted(r[:4] for r in got if r[0] != "placed") == [("gap", 1, 1, 2), ("gap", 3, 0, 1), ("piece", 2, 0, 1), ("piece", 5, 2, 1)]


def test_top_k_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x[50:150] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (None, [0.5] * 8)]
    table, stats = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), {}
    # pages of 16 rows and at most 8 children: several levels, and a leaf of 101 equal vectors
    got = topk.top_k(table.withColumn("node", F.lit(1)).withColumn("h", F.lit("x")), every=20, page_rows=16, fan=4, stats=stats).collect()
    assert sorted(got) == sorted(topk.top_k(table, every=20).collect()) and sum(stats["visits"])
    whole = np.floor(1024 * np.vstack([x, [0.5] * 8])).astype(int)
    ids = [*range(400), 10**9]
    for q in range(0, 400, 20):
        want = sorted((-int(whole[q] @ v), i) for i, v in zip(ids, whole) if i != q)[:10]
        assert [(-r.score, 10**9 if r.vec_id is None else r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_language_of_mixed_evidence(spark):
    rows = [(i, "the cat and the dog with them", "en", None, None, "h") for i in range(20)] + [(50 + i, "le chat est dans la maison avec", "fr", None, None, "g") for i in range(20)]
    rows += [(90, "the cat with them", "fr", None, None, "h"), (91, "123 456", "en", None, None, "h"), (92, None, None, None, None, None)]
    got = {r.id: (r.lang, r.accepted) for r in langid.identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, domain string, host string")).collect()}
    assert got[0] == ("en", True) and got[60] == ("fr", True) and got[90] == ("en", True) and got[91] == ("und", False) and got[92] == ("und", False)


def test_language_from_given_tables_and_corrupted_declarations(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    # the rows of one half that are held out from learning declare a wrong language
    wrong = F.when((F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(5)) == 0) & (F.col("doc_id") % 2 == 0), F.when(F.col("lang") == "en", "fr").otherwise("en")).otherwise(F.col("lang"))
    changed = docs.withColumn("true", F.col("lang")).withColumn("lang", wrong).withColumn("ll", F.lit("clash")).withColumn("best", F.lit(1))
    found = langid.identify(langid.document_evidence(changed)).alias("f").join(changed.select(F.col("doc_id").alias("id"), "true", F.length("text").alias("n"), F.col("lang").alias("said")), "id").toPandas()
    held = found[(found.said != found.true) & (found.n > 200)]
    assert len(held) > 5 and (held.lang == held.true).mean() > 0.9
    assert found[found.n > 200].accepted.mean() > 0.97


def test_language_of_other_texts_and_empty_tables(spark):
    schema = "id long, text string, declared string, suffix string, domain string, host string"
    rng = np.random.default_rng(2)
    prose = lambda words: " ".join(rng.choice(words, 60))
    en, fr = "the cat sat on a mat and then it ran away with some food".split(), "le chat est assis dans la maison avec des amis qui parlent".split()
    rows = [(i, prose(en), "en", "com", "x.com", "a.x.com") for i in range(200)] + [(1000 + i, prose(fr), "fr", "fr", "y.fr", "b.y.fr") for i in range(200)]
    rows += [(5000, "zqj xvk wwq qzx jjk " * 40, "en", "com", "x.com", "a.x.com"), (5001, "cat", None, "fr", "y.fr", "b.y.fr"), (5002, "", "en", None, None, None), (5002, "", "en", None, None, None), (None, prose(fr) * 300, "en", None, None, None)]
    got = {r.id: r for r in langid.identify(spark.createDataFrame(rows, schema)).collect()}
    assert not got[5000].accepted and got[0].accepted and got[1000].lang == "fr" and got[5002].lang == "und" and got[None].lang == "fr"
    assert langid.identify(spark.createDataFrame([], schema)).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "text", None, None, None, None)], schema)).first().lang == "und"


def test_language_of_pages(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example.{'fr' if i % 2 else 'com'}/", f"<html lang='{'fr' if i % 2 else 'en'}'><p>{'le chat est dans la maison' if i % 2 else 'the cat is in the house'}</p></html>") for i in range(40)] + [(99, None, None), (98, "http://h0.example.com/", "<p>the cat is in</p>")], "page_id long, url string, html string")
    rows = {r.id: r for r in langid.page_evidence(pages).collect()}
    assert rows[1].declared == "fr" and rows[1].suffix == "fr" and rows[1].host == "h1.example.fr" and rows[1].domain == "example.fr" and rows[1].text.split() == "le chat est dans la maison".split()
    got = {r.id: r for r in langid.identify(langid.page_evidence(pages)).collect()}
    assert got[98].lang == "en" and got[1].lang == "fr" and got[99].lang == "und" and not got[99].accepted


def test_quality_rules_learn_and_hold(spark):
    rows = [(i, ("plain words in a line. " * 9) if i % 2 else "$$$ ### | | !! " * 12) for i in range(300)] + [(1000, None), (1001, "")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, None)], "doc_id long, quality int")
    out = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), labels).toPandas()
    held = out[out.held_out & (out.doc_id < 300)]
    assert len(out) == 302 and out.score.between(0, 1).all() and (held.predicted == held.doc_id % 2).all()


def test_warc_round_trip(spark, tmp_path):
    body = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 60
    pages = spark.createDataFrame([(1, "http://a/ b", body), (2, None, body), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", body)], "page_id long, url string, html string")
    warc.write_archive(pages, str(tmp_path / "w"))
    records = warc.read_archive(spark, str(tmp_path / "w"))
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in warc.resolve_revisits(records).collect()}
    n = len(body.encode())
    assert got == {1: (n, "revisit", 2), 2: (n, "response", None), 3: (5, "response", None), 4: (5, "response", None), 5: (0, "response", None), None: (n, "revisit", 2)}
    assert {r.page_id: bytes(r.payload).decode() for r in records.where("record_type = 'response'").collect()} == {2: body, 3: "short", 4: "short", 5: ""}
    assert records.where("NOT digest_ok").count() == 0


def test_warc_of_one_member_a_record_and_missing_responses(spark, tmp_path):
    import gzip

    record = lambda i, kind, body, extra="": f"WARC/1.1\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Target-URI: http://a/{i}\r\nWARC-Payload-Digest: sha1:{hashlib.sha1(body.encode()).hexdigest()}\r\nWARC-Type: {kind}\r\n{extra}Content-Length: {len(body) + 19 if kind == 'response' else 0}\r\n\r\n{'HTTP/1.1 200 OK' + chr(13) + chr(10) * 1 + chr(13) + chr(10) + body if kind == 'response' else ''}\r\n\r\n"
    records = [record(1, "response", "one"), record(2, "revisit", "one", "WARC-Refers-To: <urn:page:1>\r\n"), record(3, "revisit", "gone", "WARC-Refers-To: <urn:page:77>\r\n"), record(4, "response", "four")]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "part-0.gz").write_bytes(b"".join(gzip.compress(r.encode()) for r in records))
    read = warc.read_archive(spark, str(tmp_path / "w"))
    assert read.count() == 4 and read.where("NOT digest_ok").count() == 0
    assert {r.page_id: (r.record_type, r.payload_bytes) for r in warc.resolve_revisits(read).collect()} == {1: ("response", 3), 2: ("revisit", 3), 3: ("revisit", None), 4: ("response", 4)}
    empty = spark.createDataFrame([], "page_id long, url string, html string, digest string, salt string")
    warc.write_archive(empty, str(tmp_path / "e"))
    assert warc.resolve_revisits(warc.read_archive(spark, str(tmp_path / "e"))).count() == 0


def test_quality_of_few_labels_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "x", 1.0) for i in range(8)] + [(3, None, "x", 1.0), (None, "w " * 50_000, "x", 1.0)], "doc_id long, text string, label string, digits double")
    labels = spark.createDataFrame([(i, i % 2, "y") for i in range(6)], "doc_id long, quality int, text string")
    out = quality.score_quality(docs, labels).toPandas()
    assert len(out) == 10 and out.score.between(0, 1).all()
    assert quality.score_quality(docs.limit(0), labels).count() == 0 and (quality.score_quality(docs, labels.limit(0)).toPandas().score == 0.5).all()


def stage_documents(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, key string, _row string")


def test_near_dedup_stage_tells_rows_by_id_and_text(spark):
    from caseweave.llm import stages

    rng = np.random.default_rng(4)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    copy, own, other = prose(80), prose(80), prose(80)
    rows = [(3, copy), (7, copy), (7, own), (9, own + " end"), (None, other), (None, other), (11, None), (11, None), (12, ""), (13, "one two"), (14, "one two")]
    docs = stage_documents(spark, [(i, t, "en", "s", 1) for i, t in rows])
    out = stages.near_dedup(spark, docs, "")
    assert out.columns == docs.columns and {r._row for r in out.collect()} == {"c"}
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(3, copy), (7, own), (None, other), (11, None), (12, ""), (13, "one two")])


def test_stages_keep_columns_and_take_empty_tables(spark):
    from caseweave.llm import stages

    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog " * 5, "en", "ab"[i % 2] if i % 5 else None, 9) for i in range(40)] + [(90, None, None, None, 0), (91, "", "en", "a", 0), (91, "", "en", "a", 0), (None, "the end of it all", "en", "b", 3)]
    docs = stage_documents(spark, rows)
    for stage in (stages.language_id, stages.near_dedup, stages.suffix_dedup, stages.mix_sources):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.count() > 0, stage
        assert stage(spark, docs.limit(0), "").count() == 0, stage
    assert {r.doc_id for r in stages.language_id(spark, docs, "").collect()} == {*range(40), None}
    taken = Counter(r.doc_id for r in stages.mix_sources(spark, docs, "").collect())
    assert max(n for i, n in taken.items() if i != 91) <= 2 and taken[91] in (0, 2, 4)
    assert stages.pack(spark, docs, "").select("doc_id", "piece").count() == len(rows) and stages.pack(spark, docs.limit(0), "").count() == 0


def test_pipeline_runs(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.where("offset + length > 4096").count() == 0


def test_special_tokens_are_told_by_their_case():
    from tokenizers import Tokenizer

    from caseweave.llm import packing

    path = packing.default_tokenizer()
    texts = ["a <|ENDOFTEXT|> b", "A <|EndOfText|>, B. C", "a <|endoftext|> b", "Plain, Text.", "<|"]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in packing._encode(texts, path)] == want and len(want[0]) != len(want[2])
