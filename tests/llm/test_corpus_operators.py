"""WARC, quality, toxicity, similarity joins, fingerprints, the pipeline."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from fieldmend.llm import fingerprint, jaccard, labels, quality, toxicity, warc  # noqa: E402
from fieldmend.llm.shingles import Shingler, overlap  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_warc_round_trip(spark):
    big, small = "x" * 1500, "y" * 10
    rows = [(1, "http://a.com/p?q=1#f", big), (2, "http://b.org", big), (3, "http://b.org", small), (4, "http://b.org", small), (5, None, None), (6, "http://[bad", big), (7, "https://a.com/é", "ü" * 600), (None, "http://n.net", big), (8, "http://c.de", ""), (3, "http://b.org", small)]
    other = "z" * 1200
    rows += [(None, "http://d.net", other), (-1, "http://e.net", other), (None, None, None), (None, "http://n.net", "v" * 3000), (9, "http://l.net", "w\n" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit(1)).withColumn("digest", F.lit(2))
    index = warc.write_index(warc.write_archives(pages), block=2)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_pages(pages, index).collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if h == html and j is not None]
        top = max(same) if len(data) >= 1000 and same else None
        revisit = top is not None and top != i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    assert got == sorted(want, key=repr)
    key = warc.capture_key("http://b.org", 3, hashlib.sha1(small.encode()).hexdigest())
    one = warc.look_up(spark.createDataFrame([(key,), ("zzz",), ("",)], "key string"), index).collect()
    assert {r.page_id for r in one} == {3} and len(one) == 2
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_pages(empty, warc.write_index(warc.write_archives(empty))).count() == 0


def test_index_deals_equal_keys(spark):
    captures = spark.createDataFrame([("k", k, "p", k, 1) for k in range(200)] + [(f"a{k}", k, "p", 1000 + k, 1) for k in range(20)], warc.CAPTURES)
    index = warc.write_index(captures, block=8)
    assert max(r["lines"] for r in index[1].collect()) < 150
    assert sorted(r.offset for r in warc.look_up(spark.createDataFrame([("k",), ("k",), ("b",)], "key string"), index).collect()) == list(range(200))


def test_url_key():
    assert warc.url_key("http://WWW.Example.com:8080/a?b=1#c") == "com,example,www:8080)/a?b=1"


def test_isotonic_and_fold(spark):
    knots, values = labels.pool_adjacent(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert list(knots) == [1, 2, 3, 4] and list(values) == [0, 0.5, 0.5, 1]
    import zlib

    got = {r.doc_id: r.f for r in spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", labels.fold("doc_id", 5).alias("f")).collect()}
    assert all(got[k] == zlib.crc32(str(k).encode()) % 5 for k in range(50))


def good(rng):
    return ". ".join(" ".join(rng.choice(["the", "tree", "stands", "in", "a", "green", "field", "of", "wheat"], 9)).capitalize() for _ in range(8)) + "."


def bad(rng):
    return "!! ".join(rng.choice(["BUY", "NOW", "$$$", "WIN"], 60)) + "!!"


def test_quality(spark):
    rng = np.random.default_rng(0)
    rows = [(k, bad(rng) if k % 4 == 0 else good(rng)) for k in range(400)] + [(1000, None), (1001, ""), (None, "x"), (3, good(rng))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(9))
    known = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(0, 400, 2)] + [(1, 1), (3, None)], "doc_id long, quality int")
    out = quality.score_quality(docs, known, features=64).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out if r.doc_id is not None and r.doc_id < 400}
    right = sum((s >= 0.3) == (k % 4 != 0) for k, s in by.items())
    assert right >= 0.98 * len(by)
    kept = quality.keep_good(docs, known, features=64)
    assert kept.columns == docs.columns and 280 <= kept.count() <= 310
    none = quality.score_quality(docs, known.where("doc_id < 0")).collect()
    assert {r.score for r in none} == {0.5}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def swaps(a, b):
    """Edit distance where two neighbouring letters that changed places are one edit."""
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distance():
    terms = ["idiot", "moron", "scum", "loser", "worthless", "stem*", "stemming"]
    find = toxicity.Automaton(terms)
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("idotmrnscule"), int(rng.integers(1, 7)))) for _ in range(2000)]
    for t in terms[:5] * 2:
        for _ in range(200):
            w = list(t)
            for _ in range(int(rng.integers(0, 4))):
                k = int(rng.integers(0, len(w)))
                if rng.random() < 0.4:
                    w[k : k + 2] = w[k : k + 2][::-1]
                else:
                    w[k : k + int(rng.integers(0, 2))] = list(rng.choice(list("abio"), int(rng.integers(0, 2))))
                w = w or ["a"]
            words.append("".join(w))
    for w in words:
        near = {t: swaps(w, t) for t in terms[:5]}
        fits = {t: e for t, e in near.items() if e <= (len(t) >= 5) + (len(t) >= 9)}
        got = find.find(w)
        if w.startswith("stem"):
            assert got[0] == 0, w
        else:
            assert (got is None) == (not fits) and (got is None or (got[0] == min(fits.values()) == near[terms[got[1]]])), w
    assert find.find("stemmed") == (0, 5) and find.find("stemming") == (0, 6) and find.find("idoit") == (1, 0) and find.find("wrothles") == (2, 4)
    # An inflection under a stem keeps its edits when the word itself is a term.
    assert find.find("setmming") == (1, 6)


def test_quotation():
    find = toxicity.Automaton(["idiot", "clown"], [2.0, 1.0])
    assert toxicity.hits(toxicity.tokens_of("you idiot"), find) == (1, 0, 0, 1, 2.0, 0, 0)
    assert toxicity.hits(toxicity.tokens_of('he said "idiot" to the crowd'), find) == (0, 0, 1, 1, 0, 0, 2.0)
    assert toxicity.hits(toxicity.tokens_of("such an 1diot and idiott clown"), find) == (1, 2, 0, 2, 1.0, 2.0, 0)
    assert toxicity.hits([], find) == (0, 0, 0, 0, 0, 0, 0)


def test_lexicon_equals_plain_counts(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), int(rng.integers(3, 9)))) for _ in range(60)]
    rows = [(k, " ".join([*rng.choice(words, 12), *(["grobian", "lumpchen"] if k % 5 == 0 else [])]), int(k % 5 == 0)) for k in range(300)]
    counted = toxicity.term_counts(spark.createDataFrame(rows, "doc_id long, text string, label int"))
    n, bad = {}, {}
    for _, text, label in rows:
        found = {w for w in text.split() if len(w) > 3}
        for t in found | {w[:k] + "*" for w in found for k in range(4, min(9, len(w)))}:
            n[t], bad[t] = n.get(t, 0) + 1, bad.get(t, 0) + label
    got = {r.term: (sum(r[f"n{k}"] for k in range(4)), sum(r[f"toxic{k}"] for k in range(4))) for r in counted.collect()}
    assert got == {t: (n[t], bad[t]) for t in n}
    part = {r.doc_id: r.p for r in spark.range(300).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "pmod(xxhash64(doc_id, 13), 4) p").collect()}
    totals = [(sum(p == k for p in part.values()), sum(p == k for d, p in part.items() if d % 5 == 0)) for k in range(4)]
    terms, weights = toxicity.learn_lexicon(counted, totals)
    assert set(terms) == {"grobian", "lumpchen"}  # their stems are one word's own
    assert all(w == pytest.approx(np.log(60.5 / 61) - np.log(0.5 / 241)) for w in weights)
    assert toxicity.learn_lexicon(counted, [(5, 0)] * 4) == ([], [])


@pytest.mark.parametrize(("sf", "least"), [("sf0.01", 0.8), ("sf0.1", 0.95)])
def test_toxicity_of_held_out_rows(spark, sf, least):
    """At sf0.01 the sample has ten toxic texts that are not English, too few to tell a term from chance."""
    docs, known = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_toxicity(docs, known).where("held_out").join(known.where("toxic is not null"), "doc_id").select("score", "toxic").collect()
    bad, fine = ([r.score for r in rows if r.toxic == k] for k in (1, 0))
    area = np.mean([(b > f) + (b == f) / 2 for b in bad for f in fine])
    assert area >= least and np.mean([f >= 0.3 for f in fine]) < 0.01 and np.mean([b >= 0.3 for b in bad]) > 0.6


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    rows = []
    for k in range(800):
        w = list(rng.choice(words, 40))
        if k % 8 == 0:
            w[3:3] = ["idiot", "stupid"]
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows + [(9000, None), (9001, ""), (None, "you idiot stupid")], "doc_id long, text string").withColumn("label", F.lit("z"))
    known = spark.createDataFrame([(k, int(k % 8 == 0)) for k in range(800)], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, known).collect()
    assert len(out) == 803
    assert sum((r.score >= 0.3) == (r.doc_id % 8 == 0) for r in out if r.doc_id is not None and r.doc_id < 800) >= 795
    assert {r.score for r in toxicity.score_toxicity(docs, known.where("doc_id < 0")).collect()} == {0.5}


def brute_components(docs, k, percent):
    sets = {}
    for d, t in docs:
        w = [x.lower() for x in (t or "").split()]
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            u = len(sets[a] | sets[b])
            if u and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * u:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), top(d)) for d in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_jaccard_components(spark, k, percent):
    rng = np.random.default_rng(k)
    vocabulary = ["".join(rng.choice(list("abcd"), 4)) for _ in range(80)]
    docs = []
    for family in range(25):
        base = list(rng.choice(vocabulary, int(rng.integers(1, 80))))
        for _ in range(int(rng.integers(1, 9))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(0, len(w)))] = str(rng.choice(vocabulary))
            docs.append((len(docs), " ".join(w)))
    docs += [(500, None), (501, ""), (502, " \t\n"), (503, "a b"), (504, "A  b"), (505, docs[3][1])]
    out = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string").withColumn("n", F.lit(1)), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_components(docs, k, percent)


def test_jaccard_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert sorted((repr(r.doc_id), r.component_id) for r in jaccard.jaccard_components(docs, 3, 90).collect()) == [("1", 1), ("1", 1), ("2", 1), ("None", 1)]
    assert jaccard.keep_one(docs, 3, 90).count() == 3
    assert jaccard.jaccard_components(docs.where("doc_id > 9"), 3, 90).count() == 0
    # Both texts of doc_id 7 lend it their links.
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "uv")
    shared = spark.createDataFrame([(3, one), (5, two), (7, one), (7, f"{two} x"), (9, f"{two} x"), (8, f"{one} y"), (1, "a b")], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.jaccard_components(shared, 3, 90).collect()}
    assert got == {(3, 38): 3, (5, 38): 3, (7, 38): 3, (7, 39): 3, (9, 39): 3, (8, 39): 3, (1, 1): 1}


def test_jaccard_of_one_long_list(spark, monkeypatch):
    """Documents of one template that don't link: all share their short lists, so a probe meets all others."""
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    frame = " ".join(f"t{k}" for k in range(60))
    docs = [(k, f"{frame} " + " ".join(f"o{k}x{j}" for j in range(4))) for k in range(150)] + [(200, " ".join(f"w{k}" for k in range(100_000))), (201, " ".join(f"w{k}" for k in range(100_001)))]
    out = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 90).collect()
    assert {r.doc_id: r.component_id for r in out} == {**{k: k for k in range(150)}, 200: 200, 201: 200}
    links = jaccard.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in links} == {**{k: 0 for k in range(150)}, 200: 200, 201: 200}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert got == {**{k: 0 for k in range(1, 41)}, 101: 100}


def test_words_that_sums_cannot_tell_apart(spark):
    """Thue and Morse's word and its complement have equal polynomial hashes modulo 2 ** 64, whatever the base."""
    for n in (64, 256, 1024, 4096):
        word = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
        one, two = Shingler(3).sets([f"x {word} y", f"x {word.translate(str.maketrans('ab', 'ba'))} y"])
        assert overlap(one, two, 0) == 0
    docs = spark.createDataFrame([(1, f"x {word} y"), (2, f"x {word.translate(str.maketrans('ab', 'ba'))} y")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs, 3, 90).collect()} == {(1, 1), (2, 2)}


def test_merge_and_overlap():
    assert jaccard.merge_lists([[1, 4, 7], [4, 7], [7, 9]], 2) == [(4, 2), (7, 3)]
    a, b = np.arange(0, 600, 2, dtype=np.uint64), np.arange(0, 600, 3, dtype=np.uint64)
    assert overlap(a, b, 0) == 100 and overlap(a, b, 101) == -1 and overlap(a[:0], b, 1) == -1
    s = Shingler(3).sets(["A b c", "a  b\tc", "a b", "", None, "a b c d" * 3000])
    assert (s[0] == s[1]).all() and len(s[2]) == 1 and len(s[3]) == len(s[4]) == 0 and len(s[5]) > 3


def test_fingerprints(spark):
    rng = np.random.default_rng(8)
    say = lambda n: "".join(rng.choice(list("abcdefgh ij\néß"), n))
    rows = [(int(k), say(int(rng.integers(0, 3000)))) for k in rng.permutation(60)] + [(100, None), (101, "ab"), (102, "𝒳𝒴𝒵")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("slice", F.lit(1))
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    make = fingerprint.Fingerprinter()
    for k, (d, t) in enumerate(order):
        t, other = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        new = t[: len(t) - n] + other[:n]
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(new.encode()).hexdigest(), make(t), make(new))
        assert r.near_edited == fingerprint.likeness(make(t), make(new)) and r.near_next == fingerprint.likeness(make(t), make(other))
    long_ = [r for r in got.values() if r.n_chars > 600]
    assert min(r.near_edited for r in long_) > 0.4 > 0.3 > max(r.near_next for r in long_)
    lone = fingerprint.fingerprints(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    tied = fingerprint.fingerprints(spark.createDataFrame([(1, "abc"), (1, "abc"), (1, "abd"), (None, "z"), (None, None)], "doc_id long, text string")).collect()
    assert len(tied) == 5
    assert fingerprint.fingerprints(docs.where("doc_id > 999")).count() == 0


def test_fingerprint_equals_a_plain_walk():
    """The walk step by step, and each slot's step by looking at all of them."""
    make = fingerprint.Fingerprinter(16)
    rng = np.random.default_rng(12)
    for text in ["a", "ab" * 40, "".join(rng.choice(list("abc é𝒳\n"), 700)), "x" * 3000]:
        points = fingerprint.code_points(text)
        kind = ((points * np.uint32(0x9E3779B1)) >> np.uint32(26)).tolist()
        under, at = [], 0
        while at < len(text):
            under.append(at)
            at += int(make.walk.bits[(len(under) - 1) % fingerprint.PERIOD, kind[at]])
        want = []
        for k, salt in enumerate(make.sample.salts):
            step = int(np.argmin(fingerprint.mix(np.arange(len(under), dtype=np.uint64) ^ salt)))
            grams = np.zeros(1, np.uint64)
            for j in range(fingerprint.GRAM):
                i = under[step] + j
                grams = fingerprint.mix(grams + np.uint64(points[i] if i < len(points) else 0xFFFFFFFF))
            want.append(int(fingerprint.mix(grams ^ (np.uint64(k) << np.uint64(40)))[0]) & 255)
        assert bytes.fromhex(make(text)) == bytes(want)


@pytest.mark.parametrize("chars", [100, 300, 1500, 6000, 20000])
def test_near_copies_recall(spark, chars):
    """Copies with 1 to 5 edits in a hundred characters (substitutions, insertions, deletions): nine tenths at least are found at each
    share; others stay apart."""
    rng = np.random.default_rng(13)
    words = ["".join(rng.choice(list("etaoinshrdlucm"), int(rng.integers(2, 9)))) for _ in range(2000)]
    rows, each = [], 20
    for k in range(3 * each):
        base = " ".join(rng.choice(words, chars // 3))[:chars]
        copy = list(base)
        for _ in range(chars * (1 + 2 * (k // each)) // 100):
            at = int(rng.integers(0, len(copy)))
            copy[at : at + int(rng.integers(0, 2))] = list("xyzq"[int(rng.integers(0, 4))] * int(rng.integers(0, 2)))
        rows += [(2 * k, base), (2 * k + 1, "".join(copy))]
    rows += [(500, rows[0][1]), (501, None), (502, ""), (None, rows[0][1])]
    out = fingerprint.near_copy_classes(spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit(1))).collect()
    got = {r.doc_id: r.component_id for r in out}
    assert len(out) == len(rows) and got[500] == 0 and got[501] == got[502] == 501 and got[None] is None
    assert all(got[2 * k] == 2 * k and got[2 * k + 1] in (2 * k, 2 * k + 1) for k in range(3 * each))
    for share in range(3):
        assert sum(got[2 * k + 1] == 2 * k for k in range(share * each, (share + 1) * each)) >= 0.9 * each


def test_near_copies_check_no_pair_of_far_lengths(spark, monkeypatch):
    """Texts are fetched only for pairs whose lengths allow a link; of an id with several texts (60) all count."""
    rng = np.random.default_rng(21)
    base = "".join(rng.choice(list("etaoinshrdlucm "), 4000))
    rows = [(k, base[: 2000 + 40 * k] + f" {k}") for k in range(50)] + [(60, "z" * 30), (60, base + "!"), (61, base + "?")]
    length, taken, near = {}, [], fingerprint._near
    for k, text in rows:
        length.setdefault(k, []).append(len(text))
    monkeypatch.setattr(fingerprint, "_near", lambda docs, pairs, share: (taken.extend(map(tuple, pairs.select("a", "b").collect())), near(docs, pairs, share))[1])
    links = fingerprint.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=10).collect()
    fits = lambda a, b: any(abs(m - n) <= int(0.05 * max(m, n)) for m in length[a] for n in length[b])
    assert taken and all(fits(a, b) for a, b in taken if 60 not in (a, b)) and not all(fits(a, b) for a in range(50) for b in range(50))
    root = {k: k for k in length}
    for a, b in sorted((r.a, r.b) for r in links):
        low, high = sorted((root[a], root[b]))
        root = {k: low if v == high else v for k, v in root.items()}
    assert set(root.values()) == {0}


def test_near_copies_check_a_pair_once(spark, monkeypatch):
    """Copies that are a little too far apart meet under many keys, but each pair comes to the last check of edits once."""
    rng = np.random.default_rng(22)
    words = ["".join(rng.choice(list("etaoinshrdlucm"), int(rng.integers(2, 9)))) for _ in range(500)]
    base, rows = rng.choice(words, 150), []
    for k in range(40):
        copy = base.copy()
        copy[rng.choice(150, 8, replace=False)] = rng.choice(words, 8)
        rows.append((k, " ".join(copy)))
    taken, near = [], fingerprint._near
    monkeypatch.setattr(fingerprint, "_near", lambda docs, pairs, share: (taken.append([tuple(r) for r in pairs.select("a", "b").collect()]), near(docs, pairs, share))[1])
    links = {(r.a, r.b) for r in fingerprint.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block=15).collect()}
    assert len(taken[-1]) == len(set(taken[-1])) > 300
    assert all((edits(rows[a][1], rows[b][1]) <= int(0.05 * max(len(rows[a][1]), len(rows[b][1])))) == ((a, b) in links) for a, b in taken[-1][:20])


@pytest.mark.parametrize("cells", [1, 1 << 14])
def test_edit_distances_of_many_pairs(monkeypatch, cells):
    """Pairs with bounds and lengths of their own, worked out together, as each would be alone."""
    monkeypatch.setattr(fingerprint, "CELLS", cells)
    rng = np.random.default_rng(23)
    left, right, most = [], [], []
    for _ in range(300):
        a = list(rng.choice(list("ab𝒳 "), int(rng.integers(0, 60))))
        b = a.copy()
        for at in rng.integers(0, len(b) + 1, int(rng.integers(0, 9))):
            b[at : at + int(rng.integers(0, 2))] = list("abc"[: int(rng.integers(0, 3))])
        left, right, most = [*left, "".join(a)], [*right, "".join(b)], [*most, int(rng.integers(0, 12))]
    want = [d if (d := edits(a, b)) <= m else None for a, b, m in zip(left, right, most, strict=True)]
    assert fingerprint.edit_distances(left, right, most) == want and want.count(None) > 20
    assert fingerprint.edit_distances([], [], []) == []


def test_near_copies_of_odd_tables(spark):
    """No rows, only nulls, one text of two million characters beside its copy, and one of a single character."""
    none = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprint.near_copy_classes(none).collect() == []
    nulls = spark.createDataFrame([(None, None), (3, None), (3, None)], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.component_id) for r in fingerprint.near_copy_classes(nulls).collect()) == [("3", 3), ("3", 3), ("None", None)]
    rng = np.random.default_rng(15)
    long = "".join(rng.choice(list("abcdefgh ij"), 2_000_000))
    rows = [(1, long), (2, long[:700_000] + "inserted" + long[700_000:]), (3, "a" * 300_000), (4, "a" * 299_990), (5, "𝒳" * 40)]
    out = fingerprint.near_copy_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5)]


def test_marks_equal_a_plain_search():
    """Anchors by looking at every window, walks step by step, each slot's feature by looking at all."""
    make = fingerprint.Anchored(8)
    rng = np.random.default_rng(16)
    for text in ["a", "ab" * 40, "".join(rng.choice(list("abc é𝒳\n"), 700)), "x" * 300]:
        points = fingerprint.code_points(text).tolist()
        n = len(points)
        grams = []
        for i in range(n + 1):
            total = 0
            for k in range(fingerprint.GRAM):
                total += (points[i + k] if i + k < n else 0xFFFFFFFF) * int(make.odd[k])
            grams.append(int(fingerprint.mix(np.array([total % (1 << 64)], np.uint64))[0]))
        anchors = [i for i in range(n) if grams[i] == min(grams[max(0, i - fingerprint.AROUND) : min(n, i + fingerprint.AROUND + 1)])]
        want = np.zeros(8, np.uint16)
        for v, steps in enumerate(fingerprint.REACH):
            features = set()
            for i in anchors:
                at = i
                for step in range(steps):
                    if at < n:
                        at += int(make.bits[step, (points[at] * 0x9E3779B1 >> 26) % fingerprint.CLASSES])
                features.add((grams[i] * 3 + grams[at] + steps) % (1 << 64))
            found = fingerprint.mix(np.array(sorted(features), np.uint64))
            for slot in range(v, 8, len(fingerprint.REACH)):
                want[slot] = int(fingerprint.mix(found ^ make.salts[slot]).min()) & 0xFFFF
        assert make(text) == want.astype("<u2").tobytes()


def test_fingerprints_of_equal_ids_are_sliced(spark):
    docs = spark.createDataFrame([(7, f"text {k % 3}") for k in range(90)] + [(None, "t")] * 90, "doc_id long, text string").repartition(3)
    sizes = [r["n"] for r in fingerprint.ordered(docs, 6).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 180 and len(sizes) > 4 and max(sizes) < 80
    assert fingerprint.fingerprints(docs).count() == 180


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_fingerprints_across_tasks(spark, parts, monkeypatch):
    """Whatever the number of tasks, also of empty ones, each document is compared with the one that follows it."""
    monkeypatch.setattr(fingerprint, "SLICE_CHARS", 2000 // parts)
    rows = [(k, f"text {k} " * 6) for k in range(23)] + [(5, "text again"), (None, "n")]
    got = sorted(map(tuple, fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()), reverse=True)
    make, want = fingerprint.Fingerprinter(), []
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        new = fingerprint.edited(t, after)
        want.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), make(t), make(new), fingerprint.likeness(make(t), make(new)), fingerprint.likeness(make(t), make(after))))
    assert got == sorted(want, key=repr)


def test_a_plan_of_many_ranges_is_short(spark):
    import time

    docs = spark.createDataFrame([(k, "t") for k in range(50)], "doc_id long, text string")
    began = time.time()
    plan = fingerprint.ordered(docs, 2000)._jdf.queryExecution().executedPlan().toString()
    assert time.time() - began < 10 and len(plan) < 5000


def test_near_copies_and_edit_distance(spark):
    rng = np.random.default_rng(9)
    base = "".join(rng.choice(list("abcdefgh ij"), 800))
    other = "".join(rng.choice(list("abcdefgh ij"), 800))
    docs = spark.createDataFrame([(1, base), (2, base[:400] + "X" + base[400:]), (3, other), (4, base)], "doc_id long, text string")
    assert {(r.a, r.b) for r in fingerprint.near_copies(docs).collect()} == {(1, 2)}
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), int(rng.integers(0, 12)))) for _ in range(2))
        d = edits(a, b)
        assert fingerprint.edit_distance(a, b, 12) == d and (d == 0 or fingerprint.edit_distance(a, b, d - 1) is None)
    for _ in range(15):
        # Long equal stretches: they are passed in blocks.
        a = "".join(rng.choice(list("ab"), int(rng.integers(200, 500))))
        b = list(a)
        for at in rng.integers(0, len(b) - 1, int(rng.integers(0, 6))):
            b[at : at + int(rng.integers(0, 2))] = "ab"[: int(rng.integers(0, 3))]
        b = "".join(b)
        d = edits(a, b)
        assert fingerprint.edit_distance(a, b, 30) == d == fingerprint.edit_distance(b, a, d) and (d == 0 or fingerprint.edit_distance(a, b, d - 1) is None)


@pytest.mark.parametrize("block", [1000, 7])
def test_near_copies_in_hot_buckets(spark, block):
    rng = np.random.default_rng(10)
    letters, slots = list("abcdefgh ij"), 32
    rows = []
    for _ in range(30):
        base = rng.choice(letters, 400)
        for _ in range(4):
            w = base.copy()
            w[rng.integers(0, 400, int(rng.integers(0, 12)))] = "X"
            rows.append((len(rows), "".join(w)))
    make, keys = fingerprint.Anchored(slots), fingerprint.band_slots(slots, 12, 1)
    like = lambda a, b: float(fingerprint.alike(*fingerprint.marks_of([a, b])))
    marks = {d: make(t) for d, t in rows}
    # Keys of one slot: buckets hold many documents that are unlike their smallest doc_id.
    distinct = [(d, t) for k, (d, t) in enumerate(rows) if t not in [x[1] for x in rows[:k]]]
    root = {d: d for d, _ in distinct}
    every = set()
    for i, (a, s) in enumerate(distinct):
        for b, t in distinct[i + 1 :]:
            x, y = fingerprint.marks_of([marks[a], marks[b]])
            if any((x[some] == y[some]).all() for some in keys) and like(marks[a], marks[b]) >= 0.7 and fingerprint.edit_distance(s, t, 20) is not None:
                every.add((a, b))
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    links = fingerprint.near_copies(docs, least=0.7, share=0.05, slots=slots, bands=12, band=1, block=block)
    got = {(r.a, r.b): r.likeness for r in links.collect()}
    assert set(got) <= every and all(x == like(marks[a], marks[b]) for (a, b), x in got.items())
    tops = {r.node: r.root for r in jaccard.components(links.select("a", "b")).collect()}
    assert {d: tops.get(d, d) for d in root} == root and len(every) > 20


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id for r in docs.select("doc_id").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and after <= before and after, name
        before = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before
    rows = jaccard.jaccard_components(docs.select("doc_id", "text"), 5, 80).where("component_id <> doc_id").count()
    assert rows == 0


def test_quality_equals_a_plain_fit(spark):
    """Random features, summed normal equations, ridge and calibration against numpy on the same rows."""
    rng = np.random.default_rng(21)
    rows = [(k, bad(rng) if rng.random() < 0.3 else good(rng)) for k in range(300)]
    rows += [(300 + k, rows[k][1]) for k in range(5)] + [(400, None), (401, "word " * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = {d: int("BUY" not in (t or "BUY")) for d, t in rows}
    marks |= {d: 1 - marks[d] for d in (4, 11, 50)}
    known = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    got = {r.doc_id: (r.held_out, r.score) for r in quality.score_quality(docs, known, features=16, gamma=0.1, ridge=2.0).collect()}
    stats = {d: np.array(quality.statistics(t)) for d, t in rows}
    held = {d: __import__("zlib").crc32(str(d).encode()) % 5 == 0 for d in stats}
    apart = {r.doc_id: r.a for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 11), 5) = 0 AS a").collect()}
    train = [d for d in stats if not held[d]]
    x = np.array([stats[d] for d in train])
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    draw = np.random.default_rng(quality.SEED)
    w, b = draw.normal(0.0, np.sqrt(0.2), (x.shape[1], 16)), draw.uniform(0, 2 * np.pi, 16)

    def features(d):
        z = np.clip((stats[d] - mean) / scale, -6, 6)
        return np.append(np.sqrt(2 / 16) * np.cos(z @ w + b), 1.0)

    f = np.array([features(d) for d in train if not apart[d]])
    y = np.array([marks[d] for d in train if not apart[d]], float)
    penalty = np.diag([2.0] * 16 + [1e-9])
    weights = np.linalg.solve(f.T @ f + penalty, f.T @ y)
    cells = {}
    for d in train:
        if apart[d]:
            cells.setdefault(np.round(np.clip(features(d) @ weights, -1, 2) * 2000 / 3), []).append(marks[d])
    at = sorted(cells)
    n = np.array([len(cells[c]) for c in at], float)
    rate = np.array([np.mean(cells[c]) for c in at])
    # Isotonic values by the largest mean from the left of the smallest mean to the right.
    best = [max(min((rate[i : j + 1] @ n[i : j + 1]) / n[i : j + 1].sum() for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
    knots, values = labels.pool_adjacent(np.array(at) * 3 / 2000, rate, n)
    assert np.interp(np.array(at) * 3 / 2000, knots, values) == pytest.approx(best)
    size = max(1.0, n.sum() / len(values))
    values = np.maximum.accumulate((values * size + rate @ n / n.sum()) / (size + 1.0))
    for d in stats:
        assert got[d] == (held[d], pytest.approx(float(np.interp(features(d) @ weights, knots, np.clip(values, 0, 1))), abs=1e-6)), d
