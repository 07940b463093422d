"""Each operator against a brute-force version on a fixture of hard cases, and on an empty table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import fingerprint, hmm, langid, mixcoder, mixing, packing, piececount, quality, simhash, tokens, toxicity

from .conftest import texts

ROWS = texts()
SPACES = " \t\n\x0b\x0c\r"


def split(t):
    return [w for w in re.split("[" + SPACES + "]+", t or "") if w]


def multiset(df):
    return Counter(tuple(r) for r in df.collect())


# -- 1 -----------------------------------------------------------------------------------------------------------------
def test_fingerprints(docs):
    order = sorted(ROWS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    keys = lambda t: set(Counter(t.split("\n")).items())
    want = Counter()
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + n[:h]
        near = lambda a, b: round(len(keys(a) & keys(b)) / len(keys(a) | keys(b)), 9)
        want[(d, len(t), hashlib.sha256(e.encode()).hexdigest(), near(t, e), near(t, n))] += 1
    out = fingerprint.fingerprints(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in out) == want
    prints = defaultdict(set)
    for r in out:
        prints[r["n_chars"], r["doc_id"] in (40, 41)].add(r["fingerprint"])
    assert len(prints[len(dict(ROWS)[40]), True]) == 1  # equal texts, equal fingerprints


def test_more_ranges_change_nothing(docs, monkeypatch):
    before = sorted(map(repr, fingerprint.fingerprints(docs).collect()))
    monkeypatch.setattr(fingerprint, "RANGE_BYTES", max(1, sum(len((t or "").encode()) for _, t in ROWS) // 60))
    assert sorted(map(repr, fingerprint.fingerprints(docs).collect())) == before


@pytest.mark.parametrize("bounds", [[], [5], [1, 5, 9], list(range(-50, 50, 7))])
def test_ranges_by_bisection(spark, bounds):
    got = spark.range(-60, 60).select("id", fingerprint._above(F.col("id"), bounds).alias("n")).collect()
    assert [r["n"] for r in got] == [sum(b > r["id"] for b in bounds) for r in got]


def test_fingerprints_of_nothing(no_docs):
    assert fingerprint.fingerprints(no_docs).count() == 0


def test_peeling_and_retry(spark):
    r = random.Random(1)
    rows = []
    for i, (a, b) in enumerate([(0, 0), (3, 2), (10, 9), (200, 0), (500, 800), (1, 0)]):
        common = [r.getrandbits(63) for _ in range(50)]
        rows.append((i, 0, common + [r.getrandbits(63) for _ in range(a)], common + [r.getrandbits(63) for _ in range(b)], a, b))
    df = spark.createDataFrame(rows, "rid long, kind int, a array<bigint>, b array<bigint>, na int, nb int")
    p = df.select("na", "nb", fingerprint.peel(fingerprint.subtract(fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b")))).alias("p")).collect()
    for x in p:
        if x["na"] + x["nb"] <= 5:
            assert x["p"]["left"] == 0
        if x["p"]["left"] == 0:
            assert (len(x["p"]["plus"]), len(x["p"]["minus"])) == (x["na"], x["nb"])
        assert x["na"] + x["nb"] < 100 or x["p"]["left"] > 0
    found = {x["rid"]: (set(x["plus"]), set(x["minus"])) for x in fingerprint._retry(df.drop("na", "nb")).collect()}
    assert found == {x[0]: (set(x[2]) - set(x[3]), set(x[3]) - set(x[2])) for x in rows}


def test_differing_paragraphs_are_recovered(spark):
    r = random.Random(4)
    line = lambda: "".join(r.choice("abcdef ") for _ in range(30))
    base = [line() for _ in range(400)]
    versions = [(0, base, base), (1, base, base[:200] + [line()] + base[201:]), (2, base, [line() for _ in range(500)]), (3, ["x", "x", "y"], ["x", "y", "y"]), (4, None, base[:1])]
    text = lambda v: None if v is None else "\n".join(v)
    pairs = spark.createDataFrame([(i, text(a), text(b)) for i, a, b in versions], "rid long, a string, b string")
    keys = {x["rid"]: (set(x["ka"]), set(x["kb"])) for x in pairs.select("rid", *[fingerprint.digests(F.coalesce(F.col(k), F.lit(""))).alias(f"k{k}") for k in "ab"]).collect()}
    got = {x["rid"]: (set(x["plus"]), set(x["minus"])) for x in fingerprint.differences(pairs).collect()}
    assert got == {i: (a - b, b - a) for i, (a, b) in keys.items()} and [len(got[3][k]) for k in (0, 1)] == [2, 2]


# -- 2 -----------------------------------------------------------------------------------------------------------------
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


ODD = ["don't we'll I'M", "a<|endoftext|>b <|startoftext|>", "İstanbul ΣΑΣ ΟΔΟΣ", "été ́x", "日本語 한국어", "a b c\x1cd\x85e", "12,345.67 x2y", "«word» ... !!! #$%", "\t\r\n", "ǅ ß ﬁ", "​ zero", "ab'S re's"]


def test_ids_are_the_librarys():
    enc, lib = tokens.Encoder(tokens.default_path()), library()
    for batch in ([t for _, t in ROWS], ODD, ODD[::-1]):
        for t, raw in zip(batch, enc.encode(batch)):
            assert np.frombuffer(raw, enc.dtype).tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def test_ids_of_any_words_are_the_librarys():
    r = random.Random(21)
    enc, lib = tokens.Encoder(tokens.default_path()), library()
    letters = "abcdefgehinstABCXYZéÉßñøØŒœǅİıſªµ" + "".join(map(chr, range(0x100, 0x260, 7)))
    other = "!?.,;:<|>()'\"-0123456789 \n\tΣσ日🙂\u0301"
    words = ["".join(r.choice(letters if r.random() < 0.9 else other) for _ in range(r.randint(0, 14))) + r.choice(["", "", ".", "!?", "...", ",\n"]) for _ in range(20_000)]
    batch = [" ".join(words[i : i + 40]) for i in range(0, len(words), 40)] + ["a" * 31, "a" * 32 + ".", "é" * 15, "é" * 16, "x" + "!" * 40, " ", "  a  b "]
    for t, raw in zip(batch, enc.encode(batch)):
        assert np.frombuffer(raw, enc.dtype).tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_coder_round_trips():
    rng = np.random.default_rng(0)
    parts = [rng.integers(0, 49_408, n) for n in (0, 1, 2, 17, 4096, 4097, 9000)] + [np.zeros(9000, int), rng.integers(0, 3, 5000), np.tile(np.arange(50), 300), np.arange(49_000)]
    got = mixcoder.read_segments(mixcoder.write_segments(parts, 49_408))
    assert all(np.array_equal(a, b) for a, b in zip(parts, got)) and len(got) == len(parts)


def test_coder_uses_its_predictions():
    rng = np.random.default_rng(1)
    skewed = np.minimum(rng.pareto(1, 20_000) * 20, 49_407).astype(int)
    assert len(mixcoder.write_segments([np.tile(np.arange(1000, 1050), 400)], 49_408)[0]) < 20_000 * 2 / 20
    assert len(mixcoder.write_segments([skewed], 49_408)[0]) < 20_000 * 2 * 0.6
    coded = lambda ids: mixcoder.write_segments([ids], 49_408, block=4096)[0]
    alone = coded(skewed[:4096])[24:]
    assert alone == coded(np.concatenate([skewed[:4096], skewed]))[12 + 12 * 6 :][: len(alone)]  # blocks start anew


def test_coder_notices_damage():
    raw = bytearray(mixcoder.write_segments([np.arange(5000) % 777], 49_408)[0])
    raw[-40] ^= 1
    with pytest.raises(mixcoder.ChecksumError):
        mixcoder.read_segments([bytes(raw)])


def test_token_files(docs, no_docs):
    lib, at, want = library(), 0, Counter()
    for d, t in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, mixcoder.END_ID], "<u4")
        want[(d, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
        at += len(ids)
    from tessera.llm import common

    files = common.write_table(mixcoder.encode(docs))
    assert multiset(mixcoder.located(files)) == want
    one = mixcoder.located(files, with_ids=True).where("doc_id = 53").first()
    assert one["ids"] == [*lib.encode("one", add_special_tokens=False).ids, mixcoder.END_ID]
    assert mixcoder.located(common.write_table(mixcoder.encode(no_docs))).count() == 0


# -- 3 -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("singles", [True, False])
def test_automaton_is_greedy(singles):
    r = random.Random(2)
    for _ in range(400):
        v = {bytes(r.choice(b"abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(1, 9))} | ({b"a", b"b", b"c"} if singles else set())
        a = piececount.Automaton(v)
        for _ in range(5):
            t, n, i = bytes(r.choice(b"abcd") for _ in range(r.randint(0, 14))), 0, 0
            while i < len(t):
                i += next((k for k in range(5, 0, -1) if t[i : i + k] in v and i + k <= len(t)), 1)
                n += 1
            assert a.count(t) == n


def test_piece_counts(docs, no_docs):
    v = set(piececount.read_vocabulary(piececount.default_path()))
    most = max(map(len, v))

    def pieces(w):
        w, n = b" " + w.encode(), 0
        while w:
            k = next(k for k in range(min(most, len(w)), 0, -1) if w[:k] in v)
            w, n = w[k:], n + 1
        return n

    cache: dict = {}
    want = Counter((d, len(split(t)), sum(cache.setdefault(w, None) or cache.update({w: pieces(w)}) or cache[w] for w in split(t))) for d, t in ROWS)
    assert multiset(piececount.counts(docs)) == want
    assert piececount.counts(no_docs).count() == 0


# -- 4 -----------------------------------------------------------------------------------------------------------------
def base_counts(t):
    t = t or ""
    w = split(t)
    lines = [x for x in t.split("\n") if split(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
    return (*n, n[0] < 10 or 100 * n[4] > 20 * n[0])


def test_quality_base(docs, no_docs):
    out = quality.judged(docs)
    got = Counter((r["doc_id"], *r["__q"][1:3], r["__q"]["n_symbols"], r["__q"]["n_dup_lines"], r["__q"]["n_repeat_words"], r["__failed"]) for r in out.collect())
    assert got == Counter((d, *base_counts(t)) for d, t in ROWS)
    assert not out.where("__failed AND __kept").count() and out.where("__p < 0 OR __p > 1 OR __p IS NULL").count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and multiset(kept) <= multiset(docs) and kept.count() == out.where("__kept").count()
    assert quality.judged(no_docs).count() == 0


def test_quality_verdict_is_the_posteriors(docs):
    """The kept column from the votes of whole texts, by the formula of a fitted model."""
    rows = [r.asDict(recursive=True) for r in quality._judged(docs, ["doc_id"]).collect()]
    names = list(quality.rules())
    p = [0.0] * len(rows)
    voted = [i for i, r in enumerate(rows) if r["__q"]["n_words"]]
    for i in voted:
        p[i] = 1 / (1 + math.exp(4 * sum(rows[i]["__v"][k] == quality.BAD for k in names) - 2))
    prior = last = None
    for _ in range(quality.ROUNDS):
        g = sum(p[i] for i in voted)
        prior = (g + 1) / (len(voted) + 2)
        odds = {}
        for k in names:
            for x in (quality.BAD, 0, quality.GOOD):
                hit = [i for i in voted if rows[i]["__v"][k] == x]
                hg = sum(p[i] for i in hit)
                odds[k, x] = math.log((hg + 1) / (g + 3) / ((max(len(hit) - hg, 0) + 1) / (len(voted) - g + 3)))
        if last is not None and abs(prior - last) < quality.SETTLED:
            break
        last = prior
        for i in voted:
            p[i] = 1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(odds[k, rows[i]["__v"][k]] for k in names)))
    for r in rows:
        want = 1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(odds[k, r["__v"][k]] for k in names)))
        assert abs(r["__p"] - want) < 1e-6 and r["__kept"] == (not r["__failed"] and r["__p"] >= 0.5)


def test_label_model_finds_the_better_rules(spark):
    r = random.Random(3)
    rows = Counter()
    for _ in range(4000):
        good = r.random() < 0.8
        said = lambda right, silent: 0 if r.random() < silent else (1 if good == (r.random() < right) else -1)
        rows[(said(0.98, 0.1), said(0.95, 0.2), said(0.55, 0.5), said(0.97, 0.4), int(good))] += 1
    df = spark.createDataFrame([(*k, n) for k, n in rows.items()], "a int, b int, c int, d int, good int, n long")
    m = quality.fit(df.groupBy("a", "b", "c", "d").agg(F.sum("n").alias("n")), list("abcd"))
    power = {k: math.log(m.given[k][1][0] / m.given[k][1][1]) - math.log(m.given[k][-1][0] / m.given[k][-1][1]) for k in "abcd"}
    assert min(power[k] for k in "abd") > 2 * power["c"] and abs(m.prior - 0.8) < 0.05
    p = df.withColumn("p", m.posterior({k: F.col(k) for k in "abcd"}))
    right = p.agg(F.sum(F.when((F.col("p") >= 0.5) == (F.col("good") == 1), F.col("n")).otherwise(0))).first()[0]
    assert right > 0.95 * 4000


def test_label_model_rounds_are_one_job(spark):
    """Not a plan for each round, which fills the driver's memory; and the rounds in whole: by the formula."""
    r = random.Random(7)
    rows = [(*v, r.randrange(1, 60)) for v in [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)][:25]]
    df = spark.createDataFrame(rows, "a int, b int, c int, n long")
    sc = spark.sparkContext
    sc.setJobGroup("label_model", "")
    m = quality.fit(df, list("abc"))
    jobs = len(sc.statusTracker().getJobIdsForGroup("label_model"))
    sc.setJobGroup("", "")
    assert jobs == 1
    total, last = sum(x[3] for x in rows), None
    p = [1 / (1 + math.exp(4 * sum(v == quality.BAD for v in x[:3]) - 2)) for x in rows]
    for _ in range(quality.ROUNDS):
        g = sum(q * x[3] for q, x in zip(p, rows))
        prior, given = (g + 1) / (total + 2), []
        for i in range(3):
            hits = {v: [(x[3], q * x[3]) for x, q in zip(rows, p) if x[i] == v] for v in (-1, 0, 1)}
            given.append({v: ((sum(b for _, b in h) + 1) / (g + 3), (max(sum(a for a, _ in h) - sum(b for _, b in h), 0) + 1) / (total - g + 3)) for v, h in hits.items()})
        if last is not None and abs(prior - last) < quality.SETTLED:
            break
        last = prior
        p = [1 / (1 + math.exp(-math.log(prior / (1 - prior)) - sum(math.log(given[i][x[i]][0] / given[i][x[i]][1]) for i in range(3)))) for x in rows]
    assert abs(m.prior - prior) < 1e-9 and all(abs(m.given[k][v][c] - given[i][v][c]) < 1e-9 for i, k in enumerate("abc") for v in (-1, 0, 1) for c in (0, 1))


# -- 5 -----------------------------------------------------------------------------------------------------------------
def test_places_minimise_the_sum_of_squares():
    r = random.Random(4)
    for cap in (10, 64):
        lengths = np.array([r.randint(1, cap) for _ in range(300)])
        seq, off = packing.place(lengths, cap)
        gaps: dict[int, int] = {}
        square = lambda g: sum(c * c for k, c in Counter(g.values()).items() if 0 < k < cap)
        for s, b, o in zip(lengths.tolist(), seq.tolist(), off.tolist()):
            choices = [k for k, g in gaps.items() if g >= s] + [-1]
            best = min(square({**gaps, (len(gaps) if k < 0 else k): (cap if k < 0 else gaps[k]) - s}) for k in choices)
            assert o == cap - gaps.get(b, cap)
            gaps[b] = gaps.get(b, cap) - s
            assert gaps[b] >= 0 and square(gaps) == best


def test_packing_leaves_its_worker_small(spark):
    """What a task of many texts has freed isn't kept by the process, which Spark uses again."""

    class Asked:
        sparkSession = spark
        select = lambda self, *_: self

        def mapInArrow(self, run, _):
            return run

    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 1e6

    run = packing.pieces(Asked())
    r = random.Random(4)
    text = lambda: " ".join("".join(r.choices("abcdefghij", k=7)) for _ in range(50_000))
    batches = lambda n: (pa.RecordBatch.from_arrays([pa.array([i]), pa.array([text() * 10])], names=["doc_id", "text"]) for i in range(n))
    assert len(list(run(batches(1)))) == 1
    before = held()
    assert sum(b.num_rows for b in run(batches(16))) > 16
    assert held() - before < 100


def test_packing(docs, no_docs):
    lib, want = library(), Counter()
    for d, t in ROWS:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        for k, at in enumerate(range(0, len(ids), packing.CAPACITY)):
            want[(d, k, at, len(ids[at : at + packing.CAPACITY]), zlib.crc32(ids[at : at + packing.CAPACITY].tobytes()))] += 1
    out = packing.packed(docs, ids=True).collect()
    assert Counter(tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in out) == want
    by = defaultdict(list)
    for r in out:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        x.sort()
        assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:])) and sum(n for _, n in x) <= packing.CAPACITY
    total = sum(k[3] * n for k, n in want.items())
    assert len(by) <= -(-total // packing.CAPACITY) + 2
    assert packing.packed(no_docs).count() == 0


# -- 6 -----------------------------------------------------------------------------------------------------------------
def insulting(spark, n=900):
    r = random.Random(6)
    plain = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    bad = ["zorkam", "zorkel", "quimbo", "vexlat"]
    rows, labels = [], []
    for i in range(n):
        w, toxic = [r.choice(plain) for _ in range(60)], r.random() < 0.15
        if toxic:
            for k in r.sample(range(60), 3):
                w[k] = r.choice(bad).title()
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_held_out(spark):
    docs, labels = insulting(spark)
    out = toxicity.scores(docs, toxicity.fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 100 and np.mean([r["predicted"] == r["toxic"] for r in out]) > 0.97
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in out)


def test_toxicity_edges(spark, docs, no_docs):
    plain, labels = insulting(spark)
    scorer = toxicity.fit(plain, labels)
    out = toxicity.scores(docs, scorer)
    assert out.count() == len(ROWS) and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    clean = toxicity.keep_clean(plain.withColumn("score", F.lit("x")), labels)
    assert clean.columns == ["doc_id", "text", "score"] and 600 < clean.count() < 900
    assert toxicity.scores(no_docs, scorer).count() == 0
    assert toxicity.fit(docs, labels.where("false")) is None and toxicity.scores(docs, None).where("score != 0").count() == 0
    assert toxicity.fit(no_docs, labels) is None
    carried = toxicity.keep_clean(docs, labels)
    assert carried.columns == docs.columns and multiset(carried) <= multiset(docs) and carried.count() > 30
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 0
    assert all(r["held_out"] == held(r["doc_id"]) for r in out.collect())


def test_toxicity_knows_seeds_without_mined_entries(spark):
    rows = [(i, f"plain words number {i} and so on " + ("you stupid idiot" if i in (3, 9) else "")) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in (3, 9))) for i in range(40)], "doc_id long, toxic int")
    assert any(zlib.crc32(str(i).encode()) % 5 for i in (3, 9))
    out = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, toxicity.fit(docs, labels)).collect()}
    assert min(out[3], out[9]) > max(v for k, v in out.items() if k not in (3, 9))


def test_toxicity_scores_by_brute_force(spark):
    """Held-out scores again from the fitted weights, entry by entry over whole texts."""
    docs, labels = insulting(spark, 400)
    scorer = toxicity.fit(docs, labels)
    for r in toxicity.scores(docs, scorer).join(docs, "doc_id").where("held_out").collect():
        held = {(k, f(w)) for w in {x.strip(toxicity._EDGE).lower() for x in r["text"].split()} for k, f in toxicity.KINDS.items() if len(w) >= toxicity._LEAST[k]}
        z = scorer.b + sum(scorer.w[n] for e, n in scorer.features.number.items() if e in held)
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9


def test_label_model_by_brute_force():
    """One round of EM from the label's start, by loops."""
    r = np.random.default_rng(3)
    y = r.random(200) < 0.4
    v = np.stack([np.where(r.random(200) < 0.9, y, ~y) * 2 - 1, (y & (r.random(200) < 0.7)) * 1, (y & (r.random(200) < 0.6)) * 1], 1).astype(float)
    rounds, toxicity.ROUNDS = toxicity.ROUNDS, 1
    try:
        got = toxicity.label_model(v, 0)
    finally:
        toxicity.ROUNDS = rounds
    p = [0.5 + 0.4 * x[0] for x in v]
    n, t = len(v), sum(p)
    rest = [[x[k] - p[i] * sum(p[j] * v[j][k] for j in range(n)) / t - (1 - p[i]) * sum((1 - p[j]) * v[j][k] for j in range(n)) / (n - t) for k in range(3)] for i, x in enumerate(v)]
    sd = [math.sqrt(sum(x[k] ** 2 for x in rest) / n) + 1e-9 for k in range(3)]
    weight = [1 / max(1, sum(abs(sum(x[a] * x[b] for x in rest) / n / sd[a] / sd[b]) for b in range(3))) for a in range(3)]
    weight[0] = 1
    given = lambda x, c, k: (sum((p[i] if c else 1 - p[i]) for i in range(n) if v[i][k] == x) + 0.5) / ((t if c else n - t) + 1.5)
    for i in range(n):
        z = math.log((t + 1) / (n - t + 1)) + sum(weight[k] * math.log(given(v[i][k], 1, k) / given(v[i][k], 0, k)) for k in range(3))
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 1e-6


def test_copies_of_a_voter_share_its_weight():
    r = np.random.default_rng(7)
    y = r.random(3000) < 0.3
    vote = lambda right: np.where(r.random(3000) < right, y, ~y) * 2 - 1
    weak = vote(0.6)
    p = toxicity.label_model(np.stack([vote(0.9), vote(0.85), vote(0.9), weak, weak, weak], 1).astype(float))
    assert np.mean((p >= 0.5) == y) > 0.9


# -- 7 -----------------------------------------------------------------------------------------------------------------
def fill(children, budget):
    """Water-filling by halving: {name: (weight, room)} to the level at which the budget is used."""
    if budget >= sum(r for _, r in children.values()):
        return {k: float(r) for k, (_, r) in children.items()}
    lo, hi = 0.0, float(budget) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(r, w * mid) for w, r in children.values()) < budget else (lo, mid)
    return {k: min(r, w * lo) for k, (w, r) in children.items()}


def test_mixing(docs, no_docs):
    weights = {"lang": {"en": 3}, "domain": {"domain1": 2}}
    for share, epochs in ((50, 4), (20, 1), (100, 1), (300, 2)):
        got = mixing.select(docs, weights=weights, share_percent=share, epochs=epochs).collect()
        langs, sources, leaf, total = ["en", "de", None], ["src0", "src0", "src1", None, "odd"], defaultdict(list), 0
        for i, (d, t) in enumerate(ROWS):
            s = sources[i % 5] or ""
            m = re.search(r"(\d{1,9})$", s)
            if n := len(split(t)):
                leaf["domain_other" if not m else f"domain{int(m[1]) % 4}", langs[i % 3] or "", s].append(("" if d is None else str(d), n))
                total += n
        supply = {k: sum(n for _, n in v) for k, v in leaf.items()}
        given = {(): total * share // 100}
        for depth, level in enumerate(mixing.LEVELS):
            new = {}
            for up, budget in given.items():
                kids = {k[: depth + 1] for k in leaf if k[:depth] == up}
                room = {k: (weights.get(level, {}).get(k[depth], 1), epochs * sum(s for x, s in supply.items() if x[: depth + 1] == k)) for k in kids}
                new |= fill(room, budget)
            given = new
        used = Counter()
        for r in got:
            used[r["__mix_domain"], r["lang"] or "", r["source"] or ""] += r["__mix_tokens"]
        for k, v in leaf.items():
            b = given[k]
            longest = max(n for _, n in v)
            assert used[k] <= b + 1e-6 and (used[k] > b - longest - 4 or used[k] == epochs * supply[k]), (share, k, used[k], b)
        assert max((r["__mix_epoch"] for r in got), default=0) < epochs
    mixed = mixing.mix(docs, epochs=1)
    assert mixed.columns == docs.columns and multiset(mixed) <= multiset(docs)
    assert mixing.select(no_docs).count() == 0


def test_mixing_carries_the_text_of_narrow_tables(docs):
    narrow = docs.select("doc_id", "text", "lang", "source")
    got = mixing.mix(narrow)
    assert got.columns == narrow.columns and multiset(got) == multiset(mixing.mix(docs).select(narrow.columns)) and got.count() > 0


def test_mixing_sql(spark, docs, tmp_path):
    import duckdb

    docs.select("doc_id", "text", "lang", "source").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sort = lambda rows: sorted(rows, key=repr)
    assert sort(con.sql(mixing.oracle()).fetchall()) == sort(tuple(r) for r in mixing.query(spark, str(tmp_path)).collect())


# -- 8 -----------------------------------------------------------------------------------------------------------------
def test_language_held_out(spark, docs, no_docs):
    r = random.Random(8)
    parts = {"aa": ["ka", "to", "mi", "ré"], "bb": ["sch", "ung", "ein", "ö"], "cc": ["ca", "ño", "mi", "la"]}
    rows = [(i, " ".join("".join(r.choice(parts[k]) for _ in range(3)) for _ in range(r.randint(3, 120))), k) for i in range(500) for k in [r.choice(list(parts))]]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net, names = langid.fit(train)
    out = langid.predict(train, net, names).join(train, "doc_id").where("held_out").collect()
    assert len(out) > 60 and np.mean([x["lang_pred"] == x["lang"] for x in out]) > 0.97
    odd = langid.predict(docs, net, names)
    assert odd.count() == len(ROWS) and odd.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert odd.where("doc_id IN (50, 51, 52) AND lang_pred != 'und'").count() == 0 and odd.where("doc_id = 53 AND lang_pred = 'und'").count() == 0
    assert langid.predict(no_docs, net, names).count() == 0 and langid.fit(no_docs) == (None, [])
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 5 == 0
    for x in odd.join(docs.select("doc_id", "text"), "doc_id").where("doc_id IN (1, 40, 53, 60, 62)").collect():
        raw = x["text"].encode()
        parts = [raw[i : i + langid.WINDOW] for i in range(0, len(raw), langid.WINDOW)]
        logs = [net.log_probabilities(np.frombuffer(p.ljust(langid.WINDOW, b"\0"), np.uint8)[None])[0] for p in parts]
        mean = sum(len(p) * v for p, v in zip(parts, logs)) / len(raw)
        share = np.exp(mean - mean.max()) / np.exp(mean - mean.max()).sum()
        assert abs(x["score"] - share.max()) < 1e-4 and x["lang_pred"] == names[int(share.argmax())] and x["held_out"] == held(x["doc_id"])


def test_network_gradients_and_tables():
    r = np.random.default_rng(9)
    net = langid.Network(3)
    w, y = r.integers(0, 256, (4, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    loss = lambda: -net.log_probabilities(w)[np.arange(4), y].mean()
    g = net.gradients(w, y, np.ones(4))
    for k, at in (("w", (3, 1)), ("c", (2,)), ("f3", (1, 2, 3)), ("b2", (4,)), ("e", (int(w[0, 0]), 1))):
        old, step = net.p[k][at], 1e-2
        net.p[k][at] = old + step
        up = loss()
        net.p[k][at] = old - step
        down = loss()
        net.p[k][at] = old
        assert abs((up - down) / (2 * step) - g[k][at]) < 2e-3 + 0.1 * abs(g[k][at]), k


# -- 9 -----------------------------------------------------------------------------------------------------------------
def brute_fingerprint(t):
    w = split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(x), seed=42) for x in ([w[i : i + 3] for i in range(len(w) - 2)] or [w])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    seen, out = set(), {}
    for f in fps:
        if f not in seen:
            group, queue = {f}, [f]
            while queue:
                x = queue.pop()
                for y in fps:
                    if y not in group and bin(x ^ y).count("1") <= 3:
                        group.add(y)
                        queue.append(y)
            seen |= group
            out |= {x: min(group) for x in group}
    return out


def test_simhash(docs, no_docs):
    fps = [(d, brute_fingerprint(t)) for d, t in ROWS]
    root = brute_components(sorted({f for _, f in fps}))
    first = defaultdict(list)
    for d, f in fps:
        if d is not None:
            first[root[f]].append(d)
    want = Counter((d, f - (1 << 64) * (f >> 63), min(first[root[f]], default=None)) for d, f in fps)
    assert multiset(simhash.near_duplicates(docs)) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(min(v) for v in first.values())
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.keep_one(no_docs).count() == 0


def brute_shingles(t):
    words = (t or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def test_stage_finds_every_pair_at_four_fifths(spark, docs, no_docs):
    r = random.Random(8)
    say = lambda n: [r.choice("abcdefghijklmnopqrst") for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(t for _, t in ROWS if t is None or len(t) < 5000)]
    for n in (5, 9, 30, 200):
        for _ in range(12):
            words = say(n)
            for edits in (0, 1, 1, 2, 5):
                for _ in range(edits):
                    words[r.randrange(n)] = r.choice("xyz")
                rows.append((len(rows), " ".join(words)))
    sets = [brute_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    far = 0
    for b in range(len(rows)):
        for a in range(b):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                far += bin(brute_fingerprint(rows[a][1]) ^ brute_fingerprint(rows[b][1])).count("1") > 3
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert far > 10  # pairs that fingerprints within 3 bits don't link
    kept = simhash.keep_dissimilar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({find(x) for x in range(len(rows))})
    assert simhash.keep_dissimilar(docs).columns == docs.columns and simhash.keep_dissimilar(no_docs).count() == 0


def test_postings_have_company(spark):
    keyed = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g h"), (3, "p q r s t u v w"), (1, "a b c d e f g"), (4, "a b c d e " + "z " * 90)], "key long, text string").repartition(3)
    got = simhash.postings(keyed, np.zeros(simhash.COUNT_BUCKETS, np.int64)).collect()
    assert {r["key"] for r in got} <= {1, 2} and all(n == 2 for n in Counter(r["shingle"] for r in got).values())


@pytest.mark.parametrize("keep", ["keep_one", "keep_dissimilar"])
def test_one_row_of_each_class_whatever_the_ids(spark, keep):
    r = random.Random(11)
    a, b, c, d = (" ".join(r.choice("abcdefghijkl") for _ in range(300)) for _ in range(4))
    rows = [(1, a), (2, b), (2, a), (2, c), (2, c), (None, a), (None, d), (None, d.upper()), (None, c)]
    kept = getattr(simhash, keep)(spark.createDataFrame(rows, "doc_id long, text string").repartition(2))
    assert Counter(tuple(x) for x in kept.collect()) == Counter([(1, a), (2, b), (2, c), (None, min(d, d.upper()))])


def test_links_lose_no_neighbour(spark):
    r = random.Random(10)
    fps = set()
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 5, 60])):
            fps.add(x)
            for b in r.sample(range(64), r.randint(0, 4)):
                x ^= 1 << b
    signed = lambda f: f - (1 << 64) * (f >> 63)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {x["node"]: x["root"] for x in simhash.components(simhash.links(df)).collect()}
    want = brute_components(sorted(fps))
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(got) == {frozenset(map(signed, g)) for g in groups(want) if len(g) > 1}


def test_settled_links_take_one_round(spark, monkeypatch):
    """Links that are stars already are written and gone through once; without links there are no components."""
    names, write = [], simhash.common.write_table
    monkeypatch.setattr(simhash.common, "write_table", lambda df, name="t", *a: names.append(name) or write(df, name, *a))
    stars = spark.createDataFrame([(5, 1), (7, 1), (9, 2)], "u long, v long")
    assert {tuple(x) for x in simhash.components(stars).collect()} == {(1, 1), (5, 1), (7, 1), (2, 2), (9, 2)} and len(names) == 2
    assert simhash.components(stars.where("u < 0").distinct()).count() == 0


def test_anchors_cover():
    r = random.Random(11)
    for _ in range(200):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(0, 3)):
            y ^= 1 << b
        row, key = simhash.anchors(np.array([x, y], np.uint64))
        assert set(key[row == 0]) & set(key[row == 1])


# -- 10 ----------------------------------------------------------------------------------------------------------------
def test_base_scores(docs, no_docs):
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    words = lambda t: [*split("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None]
    c = Counter(w for d, t in ROWS if not held(d) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter((d, held(d), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 4)) for d, t in ROWS)
    out = hmm.score(docs).collect()
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in out) == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert hmm.score(no_docs).count() == 0


def test_forward_and_counts_against_all_paths():
    import itertools

    rng = np.random.default_rng(12)
    k, m = 3, 4
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, m)))
    obs, starts, lengths = rng.integers(0, m, 11), np.array([0, 5, 6]), np.array([5, 1, 5])
    opening, trans, emit = np.zeros(k), np.zeros((k, k)), np.zeros((k, m))
    logs = []
    for s, n in zip(starts, lengths):
        o, total, add = obs[s : s + n], 0.0, []
        for path in itertools.product(range(k), repeat=int(n)):
            p = model[0][path[0]] * np.prod([model[1][a, b] for a, b in zip(path, path[1:])]) * np.prod([model[2][a, x] for a, x in zip(path, o)])
            total += p
            add.append((p, path))
        logs.append(math.log(total))
        for p, path in add:
            opening[path[0]] += p / total
            for a, b in zip(path, path[1:]):
                trans[a, b] += p / total
            for a, x in zip(path, o):
                emit[a, x] += p / total
    assert np.allclose(hmm.forward(obs, starts, lengths, model), logs)
    got = hmm.expect(obs, starts, lengths, np.ones(3, bool), model)
    assert np.allclose(got[0], opening) and np.allclose(got[1], trans) and np.allclose(got[2], emit) and abs(got[3] - sum(logs)) < 1e-9


def test_model_beats_base(spark):
    r = random.Random(13)
    say = lambda v, n: " ".join(v[min(int(r.expovariate(0.2)), len(v) - 1)] for _ in range(n))
    tongues = [[f"{p}{i}" for i in range(200)] for p in "abc"]
    docs = spark.createDataFrame([(i, say(tongues[i % 3], 80)) for i in range(300)], "doc_id long, text string")
    out = hmm.score(docs).where("held_out").collect()
    assert sum(x["score"] for x in out) > sum(x["base_score"] for x in out)


# -- the queries -----------------------------------------------------------------------------------------------------
CONTRACT = {
    "op1_": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op2_": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op4_": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op6_": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op9_": "doc_id bigint, fingerprint string, component_id bigint",
    "op10_": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
}


@pytest.mark.parametrize("op", CONTRACT)
def test_columns_of_queries(spark, op):
    from tessera.llm import queries

    (name,) = [k for k in queries.queries() if k.startswith(op)]
    got = dict(queries.queries()[name](spark, "/root/testdata/sf0.001").dtypes)
    assert {k: got.get(k) for k in (x.split(" ")[0] for x in CONTRACT[op].split(", "))} == dict(x.split(" ") for x in CONTRACT[op].split(", "))


# -- the pipeline ------------------------------------------------------------------------------------------------------
def test_pipeline(spark):
    import corpus_pipeline as c
    from tessera.llm import common

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in c.STAGES[:-1]:
        docs = common.write_table(stage(spark, docs, d), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        before = docs.count()
    kept = {r["doc_id"] for r in docs.collect()}
    out = common.write_table(c.STAGES[-1][1](spark, docs, d)).collect()
    assert {r["doc_id"] for r in out} == kept
    by = Counter()
    for r in out:
        by[r["sequence_id"]] += r["length"]
    assert max(by.values()) <= packing.CAPACITY
    assert c.run(spark, d).count() == len(out)


def test_pipeline_of_nothing(spark, no_docs, tmp_path):
    import corpus_pipeline as c

    no_docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert c.run(spark, str(tmp_path)).count() == 0


def test_pipeline_of_hard_cases(spark, docs, tmp_path):
    import corpus_pipeline as c

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows, now = multiset(docs), docs
    for _, stage in c.STAGES[:-1]:
        alone, now = stage(spark, docs, str(tmp_path)), stage(spark, now, str(tmp_path))
        assert alone.columns == now.columns == docs.columns and multiset(alone) <= rows and multiset(now) <= rows
    assert multiset(c.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct()) == Counter((d,) for d in {d for d, _ in ROWS})
    assert {r["doc_id"] for r in c.run(spark, str(tmp_path)).collect()} == {r["doc_id"] for r in now.collect()}
