"""Periodic runs, the filter audit and language identification, against plain versions of them."""

import hashlib
import zlib
from itertools import permutations

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from fieldmend.llm import filteraudit, langid, periodic, queries  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string"


def brute_runs(w, least=6, times=4):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i < len(w) - q:
            a = i
            while i < len(w) - q and w[i] == w[i + q]:
                i += 1
            if i - a + q >= max(least, times * q):
                found.setdefault((a, i + q), q)
            i += i == a
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def periodic_words(rng, n):
    w = list(rng.integers(0, rng.integers(1, 5), n))
    for _ in range(rng.integers(0, 3)):
        a, p = int(rng.integers(0, n)), int(rng.integers(1, 9))
        b = min(n, a + int(rng.integers(2, 7)) * p + int(rng.integers(0, p)))
        w[a:b] = [w[min(n - 1, a + k % p)] for k in range(b - a)]
    return np.array(w, np.int64)


@pytest.mark.parametrize("prime", [periodic.PRIME, 2, 7])
@pytest.mark.parametrize("grid", [1 << 20, 5])
def test_runs_equal_brute_force(monkeypatch, prime, grid):
    """With a prime of 2 or 7 most hashes collide, and the words decide."""
    monkeypatch.setattr(periodic, "GRID", grid)
    rng = np.random.default_rng(prime + grid)
    for _ in range(60 if grid > 5 else 12):
        texts = [periodic_words(rng, int(rng.integers(1, 80))) for _ in range(rng.integers(1, 7))] + [np.zeros(0, np.int64)]
        for least, times in ((6, 4), (2, 2), (9, 3)):
            assert periodic.runs_of(texts, least, times, prime) == [brute_runs(list(t), least, times) for t in texts]


def test_runs_of_long_texts():
    assert periodic.runs_of([np.zeros(60_000, np.int64)]) == [[(0, 60_000, 1)]]
    w = np.concatenate([np.arange(1000), np.tile(np.arange(5000, 5700), 40)[:27_999], np.arange(900)])
    assert periodic.runs_of([w, np.arange(3)]) == [[(1000, 27_999, 700)], []]
    thue = np.array([bin(k).count("1") % 2 for k in range(1 << 13)])  # has no cube, so no run
    assert periodic.runs_of([thue, 1 - thue]) == [[], []]


def digest(doc_id, text):
    """The row of op11 by the contract's own words."""
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(listed), sha(kept))


def test_op11_equals_its_contract(spark, tmp_path):
    rng = np.random.default_rng(8)
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "x y " * 9, "é ß\x0b é ß\x0cé ß é ß é", "one two " * 1_000, "w" * 100_000]
    texts += [" ".join(f"w{k}" for k in periodic_words(rng, int(rng.integers(1, 120)))) for _ in range(150)]
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)] + [(None, "b b b b b b", None, None), (3, "a", None, None), (3, "a", None, None)]
    spark.createDataFrame(rows, DOCS).withColumn("words", F.lit(1)).withColumn("runs", F.lit(2)).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op11_periodic(spark, str(tmp_path))
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = sorted((tuple(r[c] for c in names) for r in out.collect()), key=repr)
    assert got == sorted((digest(*r[:2]) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 40
    assert [t for _, t in out.select(*names).dtypes[:6]] == ["bigint"] * 6


def test_empty_tables_and_limits(spark):
    empty, known = spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert periodic.find_runs(periodic.planted(empty)).count() == 0
    assert filteraudit.audit(empty, known).count() == 0
    assert langid.identify(empty).count() == 0
    with pytest.raises(ValueError, match="two periods"):
        periodic.find_runs(empty, times=1)


def brute_audit(docs, labels):
    import re

    first, flags, out = {}, [], {}
    for doc, text, _, _ in docs:
        if doc is not None:
            first[text or ""] = min(doc, first.get(text or "", doc))
    for doc, text, _, source in docs:
        t = text or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": doc is not None and doc > first[t]}
        known = [r for r in labels if doc is not None and r[0] == doc]
        flags.append((source or "", {f for f in fails if fails[f]}, any(r[1] == 1 for r in known), any(r[2] == 1 for r in known)))
    for part in {f[0] for f in flags}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in flags if f[0] == part]
            seen = set()
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                redundant = sum(x[0] == part and f in x[1] and bool(x[1] & seen) for x in flags)
                left = [x for x in left if f not in x[1]]
                seen.add(f)
                shapley[f] += len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(x[0] == part and x[1] == {f} for x in flags), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {(*k, *v) for k, v in out.items()}


def test_audit_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    words = ["alpha", "Beta", "gamma,", "DELTA", "eps#", "ζήτα", "x|y"]
    docs = [(k, " ".join(rng.choice([*words[: int(rng.integers(1, 8))], *map(str, range(int(rng.choice([1, 150]))))], int(rng.choice([5, 199, 200, 260])))), "en", ["a", "b", None, ""][k % 4]) for k in range(60)]
    docs += [(100 + k, docs[k][1], "en", "a") for k in range(0, 60, 3)] + [(None, docs[3][1], None, "b"), (200, None, None, "b"), (201, "", None, "c"), (5, docs[5][1], "en", "b"), (202, "w " * 50_000, "en", "c")]
    labels = [(k, int(k % 3 == 0), int(k % 4 == 0)) for k in range(0, 130, 2)] + [(4, 0, 1), (None, 1, 1), (6, None, None)]
    frame = spark.createDataFrame(docs, DOCS).withColumns({c: F.lit(7) for c in ("part", "step", "failed", "good", "digest")}).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("t"))
    got = filteraudit.audit(frame, known)
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert got.columns == names
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 600 * 4 and set(rows) == brute_audit(docs, labels)


def test_audit_sends_little_and_deals_copies_out(spark):
    """Copies of one text have distinct keys in the join, and the sums are added up before the exchange."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "'same text' AS text", "'en' AS lang", "'s' AS source")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = filteraudit.audit(docs, labels)
    row = found.where("filter_order = 'EABCD' AND step = 1").first()
    assert (row.kept, row.removed) == (1, 3999)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_sum") and "Python" not in plan and "CartesianProduct" not in plan


def plain_bayes(train, text):
    """Rates by dictionaries of n-grams; without hash collisions, so only nearly the same."""

    def counts(t):
        t = "".join(c if c.isalpha() else " " for c in t.lower())
        t = " " + " ".join(t.split()) + " "
        return [t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)]

    langs = sorted({lang for _, lang in train})
    best = []
    for lang in langs:
        own = [g for t, x in train if x == lang for g in counts(t)]
        table = {}
        for g in own:
            table[g] = table.get(g, 0) + 1
        total = len(own) + langid.SMOOTH * langid.BUCKETS
        best.append(np.log(sum(x == lang for _, x in train) / len(train)) + sum(np.log((table.get(g, 0) + langid.SMOOTH) / total) for g in counts(text)))
    best = np.array(best)
    return langs[int(best.argmax())], 1 / np.exp(best - best.max()).sum()


def test_language_equals_plain_bayes(spark):
    rng = np.random.default_rng(4)
    own = {"xx": list("abcdeü"), "yy": list("bcdefg"), "zz": list("ßghñij")}
    make = lambda lang: " ".join("".join(rng.choice(own[lang], int(rng.integers(1, 5)))) for _ in range(int(rng.integers(1, 4))))
    rows = [(k, make(lang), lang, "s") for k in range(240) for lang in [sorted(own)[k % 3]]]
    odd = [(900, None, "xx", "s"), (901, "", "yy", "s"), (902, "12 !?\n", "zz", "s"), (903, "ABC" * 400_000, None, None), (None, "gg hh", "zz", None), (904, "Ünü", None, None), (905, "\U00010400 日本", None, "s"), (7, rows[7][1], rows[7][2], "s")]
    got = langid.identify(spark.createDataFrame(rows + odd, DOCS).withColumn("score", F.lit(3)).withColumn("n", F.lit(1)).repartition(3)).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r.doc_id: r for r in got}
    train = [(t, lang) for d, t, lang, _ in rows + odd if t is not None and lang is not None and (d is None or zlib.crc32(str(d).encode()) % 3 != 1)]
    for d, t, _, _ in rows + [odd[5]]:
        lang, score = plain_bayes(train, t)
        assert found[d].lang_pred == lang and found[d].score == pytest.approx(score, rel=0.02)
        assert found[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
    assert all((found[d].lang_pred, found[d].score) == ("und", 0.0) for d in (900, 901, 902))
    assert found[903].lang_pred == "xx" and not found[None].held_out and found[905].lang_pred in own


def test_language_of_bounded_samples_and_nothing_learnt(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for rows in (langid.FIT_ROWS, 20):
        r = langid.identify(docs, fit_rows=rows).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
        assert r[0] > 0.99 and r[1] > 300
    bare = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert bare.where("lang_pred <> 'und' or score <> 0").count() == 0
    monkeypatch.setattr(langid, "CELLS", langid.BUCKETS * 3)
    with pytest.raises(ValueError, match="more than 3 languages"):
        langid.identify(docs)


def test_grams_of_stretches(monkeypatch):
    text = "The quick brown—fox, jumps! over 13 lazy dogs " * 50
    whole = langid.grams(text)
    monkeypatch.setattr(langid, "STRETCH", 64)
    assert all((a == b).all() for a, b in zip(whole, langid.grams(text), strict=True))
