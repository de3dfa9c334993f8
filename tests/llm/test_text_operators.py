"""PII, tokens, packing, token files, decontamination, line dedup: against brute force and round trips."""

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from fieldmend.llm import decontaminate, linededup, packing, pii, tokenfile  # noqa: E402
from fieldmend.llm.tokens import Encoder  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, "plain words here", "en", "a", 1),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "no id at all", "en", "a", 3),
    (4, "plain words here", "en", "a", 1),
    (4, "plain words here", "en", "a", 1),
    (5, "Ünïcode ñandú \n\n  two  spaces\ttab <|endoftext|> 你好 ", "en", "a", 3),
    (6, "word " * 20_000, "en", "a", 3),
]


def frame(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute_spans(text: str) -> list[str]:
    out = []
    for rank, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text, re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


def found(spark, texts):
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in rows}


def test_pii_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    parts = ["a@b.c", "x.y_d@e.f", "@", ".", " ", "-", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (017) 555-7713", "+", "é", "99", "a@b", "0001.02.3.255", "(", "word", "𝒳", "1", "12345678901234", "_"]
    texts = ["".join(rng.choice(parts, 12)) for _ in range(400)] + ["a@b.c@d.e", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "1 " * 40 + "x"]
    got = found(spark, texts)
    for k, t in enumerate(texts):
        assert [s for s in got[k] if s.split(":")[0] in pii.BASE] == brute_spans(t), t


def test_pii_long_runs_and_added_kinds(spark):
    texts = ["a" * 200_000, "1" * 200_000, "a@" + "b." * 50_000 + "c", "pay to iban DE89370400440532013000 now", "DE89370400440532013001", "order 123-45-6789", "ssn 123-45-6789", None, ""]
    got = found(spark, texts)
    assert got[0] == got[1] == [] and got[2] == [f"email:0:{len(texts[2])}"]
    assert got[3] == ["iban:12:34"] and got[4] == [] and got[5] == [] and got[6] == ["ssn:4:15"] and got[7] == got[8] == []


def test_pii_of_many_matches(spark):
    """The time is in proportion to the matches: 200,000 in one text take seconds."""
    import time

    texts = [" ".join(f"mail a{k}@b{k % 7}.org" for k in range(n)) for n in (1000, 200_000)]
    took = []
    for text in texts:
        began = time.time()
        spans = pii.find_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["spans"]
        took.append(time.time() - began)
        where = [m.span() for m in __import__("re").finditer(r"a[0-9]+@b[0-9]\.org", text)]
        assert [(x.start, x.end) for x in spans] == where and all(x.score == 1.1 for x in spans)
    assert took[1] < 120


def test_redact(spark):
    out = {r.doc_id: r.text for r in pii.redact(spark.createDataFrame([(1, "to a@b.c, from 1.2.3.4!"), (2, None), (3, "none")], "doc_id long, text string")).collect()}
    assert out == {1: "to [email], from [ip]!", 2: None, 3: "none"}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name):
    path = public_tokenizers.path(name)
    code = Encoder(path)

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from(list("abcXYZ  \n\t'0129.,!?-éñßİœ \x1c你<|>")), max_size=40), max_size=4))
    def same(texts):
        want = [np.asarray(code.library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert code.encode(texts) == want

    same()
    # Every character of the range that is split without the library, and some beyond it.
    rng = np.random.default_rng(1)
    texts = [f"{a}{chr(c)}{b}" for c in range(0x260) for a in ("", "a", " ", "1") for b in ("", "b", " ", "'s")]
    texts += ["".join(map(chr, rng.integers(0, 0x253, 12))) for _ in range(3000)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in code.library.encode_batch(texts, add_special_tokens=False)]
    assert code.encode(texts) == want


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(frame(spark), path, capacity=64).collect()
    code = Encoder(path)
    want = {}
    for doc, text, *_ in ODD:
        ids = code.encode([text or ""])[0] + (1).to_bytes(4, "little")
        for k, at in enumerate(range(0, len(ids), 256)):
            want.setdefault((doc, k), []).append((at // 4, len(ids[at : at + 256]) // 4, zlib.crc32(ids[at : at + 256])))
    got = {}
    for r in rows:
        got.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
    assert got == want
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert len(bins) <= -(-total // 64) + 1


def test_best_fit_holds_every_capacity():
    rng = np.random.default_rng(3)
    for rule in ("norm", "dot"):
        length = rng.integers(1, 101, 500).astype(float)
        demands = np.stack([length, np.ones(500), length**2], axis=1)
        capacities = np.array([100.0, 4.0, 6000.0])
        demands = demands[demands[:, 2] <= 6000]
        bins, n = packing.best_fit(demands, capacities, rule=rule)
        sums = np.stack([np.bincount(bins, demands[:, k], n) for k in range(3)], axis=1)
        assert (sums <= capacities + 1e-6).all() and (sums > 0).all()
        assert n <= 1.5 * np.ceil((demands.sum(axis=0) / capacities).max())
    with pytest.raises(ValueError):
        packing.best_fit(demands, capacities, rule="first")
    with pytest.raises(ValueError):
        packing.best_fit(np.array([[50.0, 1.0, 6001.0]]), capacities)


def test_packing_under_limits_and_empty(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = packing.pack_documents(frame(spark), path, capacity=64, max_documents=2).collect()
    per = {}
    for r in rows:
        per[r.sequence_id] = per.get(r.sequence_id, 0) + 1
    assert max(per.values()) <= 2
    cost = {}
    for r in packing.pack_documents(frame(spark, [(k, "word " * (7 + k % 5), "en", "a", 1) for k in range(40)]), path, capacity=64, max_attention=200).collect():
        cost[r.sequence_id] = cost.get(r.sequence_id, 0) + r.length**2
    assert max(cost.values()) <= 200 and len(cost) > 20  # without the limit ten would do
    with pytest.raises(ValueError):
        packing.pack_documents(frame(spark), path, capacity=64, max_documents=0)
    same = packing.pack_documents(frame(spark, [(None, "a b c", "en", "a", 1)] * 30), path, capacity=64, group_size=4).collect()
    assert len(same) == 30 and len({r.sequence_id >> 22 for r in same}) > 1  # dealt over several groups
    assert packing.pack_documents(frame(spark, []), path).count() == 0


def test_token_files_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    code = Encoder(path)
    manifest = tokenfile.write_tokens(frame(spark).withColumn("shard", F.lit("x")), path, sequence_length=16, rows=4, shards=3)
    got = sorted(tokenfile.read_tokens(manifest).collect(), key=lambda r: r.start)
    docs = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for r, (doc, text, *_) in zip(got, docs, strict=True):
        ids = code.encode([text or ""])[0] + bytes(4)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids) // 4, zlib.crc32(ids))
        start += len(ids) // 4
    stream = np.frombuffer(b"".join(code.encode([t or ""])[0] + bytes(4) for _, t, *_ in docs), "<u4")
    shards = manifest.orderBy("shard").collect()
    reader = tokenfile.ShardReader(shards[0].path + ".arrows")
    n = shards[0].tokens
    assert reader.values(0).dtype == np.uint16 and reader.length == 16
    for k in np.random.default_rng(0).permutation(-(-n // 16)):
        mask = reader.mask(int(k))
        assert mask.sum() == min(16, n - 16 * k) and (reader.sequence(int(k))[mask] == stream[16 * k : 16 * k + 16][: mask.sum()]).all()
    assert tokenfile.read_tokens(tokenfile.write_tokens(frame(spark, []), path)).count() == 0


def test_token_files_cut_equal_ids(spark):
    """One id and one text on all rows are dealt over the shards like others."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(7, f"word {k % 5}") for k in range(100)] + [(None, "x")] * 100, "doc_id long, text string")
    manifest = tokenfile.write_tokens(docs.repartition(4), path, shards=4)
    sizes = [r.documents for r in manifest.collect()]
    assert sum(sizes) == 200 and len(sizes) == 4 and max(sizes) < 100
    got = sorted(tokenfile.read_tokens(manifest).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]] and [r.doc_id for r in got] == [None] * 100 + [7] * 100


def brute_hits(docs, items, n):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: word.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - n + 1) if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, held = words(t), set(), set()
        for size in {len(g) for g in grams}:
            for k in range(len(w) - size + 1):
                if (g := tuple(w[k : k + size])) in grams:
                    held |= grams[g]
                    hit |= set(range(k, k + size))
        out.append((d, len(w), len(hit), tuple(sorted(held))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [10_000, 0])
def test_contamination(spark, limit):
    rng = np.random.default_rng(5)
    say = lambda k: " ".join(rng.choice(["Aa", "bb", "cc", "é1"], k))
    items = [(k, say(int(rng.integers(0, 9)))) for k in range(8)] + [(2, "Aa bb"), (9, None), (10, "...")]
    docs = [(k, say(int(rng.integers(0, 60)))) for k in range(40)] + [(41, None), (41, None), (42, ""), (None, "aa bb!cc"), (43, "aa bb"), (43, "aa bb")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in decontaminate.contamination(d, b, 5, limit).collect()), key=repr)
    assert got == brute_hits(docs, items, 5)
    kept = sorted((r.doc_id for r in decontaminate.decontaminate(d, b, 5, max_broadcast_windows=limit).collect()), key=repr)
    assert kept == sorted((x[0] for x in brute_hits(docs, items, 5) if not x[2]), key=repr)


def test_contaminated_spans_are_cut(spark):
    d = spark.createDataFrame([(1, "Keep this. One two, three four! And that."), (2, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontaminate.decontaminate(d, b, 4, remove="spans").collect()}
    assert out == {1: "Keep this. ! And that.", 2: None}


def brute_lines(docs, size=3):
    seen, gone = set(), {}
    for d, t in sorted((x for x in docs if x[1] is not None), key=lambda x: x[0]):
        lines = t.split("\n")
        for k in range(len(lines) - size + 1):
            w = tuple(lines[k : k + size])
            if all(not x.strip(" ") for x in w):
                continue
            if w in seen:
                gone.setdefault(d, set()).update(range(k, k + size))
            seen.add(w)
    return {d: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ())) for d, t in docs}


def test_line_dedup(spark):
    rng = np.random.default_rng(7)
    docs = [(k, "\n".join(rng.choice(["a", "b", "", " ", "c d"], int(rng.integers(1, 12))))) for k in range(60)] + [(100, None), (101, ""), (102, "\n\n\n\n")]
    out = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, at int")).collect()}
    want = brute_lines(docs)
    assert {d: r.text for d, r in out.items()} == want
    for d, t in docs:
        n = 0 if t is None else len(t.split("\n"))
        assert out[d].fm_lines == n and out[d].at == 1
    twice = linededup.dedup_lines(spark.createDataFrame([(1, "x\ny\nz")] * 2 + [(None, "x\ny\nz"), (2, "x\ny\nz\nw")], "doc_id long, text string")).collect()
    assert sorted((repr(r.doc_id), r.text) for r in twice) == [("1", ""), ("1", ""), ("2", "w"), ("None", "x\ny\nz")]
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def brute_passages(docs, alone):
    """Later repeats of three lines, of one or two lines of so many words, and of whole texts of one or two lines."""
    seen, gone = set(), {}
    for d, t in sorted(docs):
        lines = t.split("\n")
        for span in (1, 2, 3):
            for k in range(len(lines) - span + 1):
                w = tuple(lines[k : k + span])
                if all(not x.strip(" ") for x in w) or (span < 3 and len(lines) != span and sum(len(x.split()) for x in w) < alone):
                    continue
                if w in seen:
                    gone.setdefault(d, set()).update(range(k, k + span))
                seen.add(w)
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ())) for d, t in docs}


def test_line_dedup_of_short_passages(spark):
    long_, one, two = " ".join(f"w{k}" for k in range(50)), " ".join(f"u{k}" for k in range(30)), " ".join(f"v{k}" for k in range(25))
    docs = [(1, f"a\n{long_}\nb"), (2, f"c\n{long_}\nd"), (3, f"e\n{one}\n{two}\nf"), (4, f"g\n{one}\n{two}\nh\n{one}"), (5, long_), (6, "hi"), (7, "hi"), (8, "hi\nhi"), (9, "hi\nthere"), (10, "hi\nthere"), (11, ""), (12, "\n")]
    rng = np.random.default_rng(17)
    docs += [(20 + k, "\n".join(rng.choice(["a", "b", "", " ", "c d", one, two, long_], int(rng.integers(1, 9))))) for k in range(60)]
    frame_ = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame_, alone=50).collect()}
    assert got == brute_passages(docs, 50)
    assert got[2] == "c\nd" and got[4] == f"g\nh\n{one}" and got[5] == got[7] == got[10] == "" and got[8] == "hi\nhi"


def test_line_stage_cuts_long_lines(spark):
    import corpus_pipeline

    long_ = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(1, f"a\n{long_}\nb"), (2, f"c\n{long_}\nd"), (3, long_)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, "").collect()} == {1: f"a\n{long_}\nb", 2: "c\nd"}


@pytest.mark.parametrize("limit", [10_000, 0])
def test_contamination_is_a_row_s_own(spark, limit):
    leak = "Keep this. One two, three four! And that."
    docs = [(None, leak, 1), (None, "clean text", 2), (7, leak, 3), (7, "other clean text", 4), (8, None, 5), (8, leak, 6), (9, "", 7)]
    d = spark.createDataFrame(docs, "doc_id long, text string, at int")
    b = spark.createDataFrame([(None, "one two three four"), (None, "two three four and"), (3, "three four and that")], "item_id long, text string")
    kept = decontaminate.decontaminate(d, b, 4, max_broadcast_windows=limit)
    assert kept.columns == d.columns and sorted(r["at"] for r in kept.collect()) == [2, 4, 5, 7]
    cut = decontaminate.decontaminate(d, b, 4, remove="spans", max_broadcast_windows=limit)
    assert cut.columns == d.columns
    assert {(r["doc_id"], r["text"], r["at"]) for r in cut.collect()} == {(i, "Keep this. ." if t == leak else t, k) for i, t, k in docs}
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(d, b, 4, limit).collect()}
    hit = (8, 6, ("3", None))
    assert got == {(None, *hit), (None, 2, 0, ()), (7, *hit), (7, 3, 0, ()), (8, 0, 0, ()), (8, *hit), (9, 0, 0, ())}


def test_columns_of_the_operators_own_names(spark):
    """Columns called like those that operators work with come back as they were; rows that share an id, nulls and a very
    long text go through all of them."""
    from fieldmend.llm import jaccard, quality

    extra = ["fm_key", "fm_at", "fm_row", "fm_doc", "fm_split", "fm_spans", "fm_score", "fm_id", "component_id", "n", "at", "row", "spans"]
    texts = [(1, "a@b.c says hi"), (1, "One two three four five"), (None, None), (None, ""), (2, "long words " * 60_000), (2, "l1\nl2\nl3"), (3, "x\nl1\nl2\nl3")]
    docs = spark.createDataFrame([(d, t, *range(len(extra))) for d, t in texts], "doc_id long, text string, " + ", ".join(f"{c} int" for c in extra))
    items = spark.createDataFrame([(1, "two three four five")], "item_id long, text string")
    labels_ = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id long, quality int")
    done = {
        "redact": pii.redact(docs), "lines": linededup.dedup_lines(docs).drop("fm_lines", "fm_removed"), "one": jaccard.keep_one(docs, 5, 80), "good": quality.keep_good(docs, labels_, threshold=0.0, features=8),
        **{f"{remove}{limit}": decontaminate.decontaminate(docs, items, 4, remove, limit) for remove in ("documents", "spans") for limit in (0, 1000)},
    }
    for name, out in done.items():
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(tuple(r)[2:] == tuple(range(len(extra))) for r in rows) and len(rows) == len(texts) - name.startswith("documents"), name
        empty = {"redact": lambda d: pii.redact(d), "lines": lambda d: linededup.dedup_lines(d), "one": lambda d: jaccard.keep_one(d, 5, 80)}.get(name)
        assert empty is None or empty(docs.limit(0)).count() == 0


def test_empty_tables(spark):
    from fieldmend.llm import quality, toxicity

    docs = spark.createDataFrame([], "doc_id long, text string")
    labels_ = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    for out in (pii.find_pii(docs), quality.score_quality(docs, labels_), toxicity.score_toxicity(docs, labels_), decontaminate.contamination(docs, items), decontaminate.contamination(docs, items, 10, 0), quality.keep_good(docs, labels_)):
        assert out.count() == 0
    some = frame(spark)
    assert decontaminate.decontaminate(some, items, max_broadcast_windows=0).count() == len(ODD)
    assert {r.score for r in quality.score_quality(some, labels_).collect()} == {r.score for r in toxicity.score_toxicity(some, labels_).collect()} == {0.5}
