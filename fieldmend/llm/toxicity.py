"""Toxicity scores: misspelled lexicon terms by Levenshtein automata, weighed by their context.

The lexicon (terms, and stems that many words share) is learned from labelled training rows: of all terms that are in
LEAST_DOCS training texts or more, those that are in more toxic texts than chance would put there, each weighed by its
smoothed log odds. Its trie is intersected with Levenshtein automata (one edit from five letters on, two from LONG on;
two letters that changed places are one edit): a state is a set of trie nodes with the edits spent, and states are worked
out as words need them, so a word is read letter by letter and most words leave the automaton after a few.

Around each hit, a window of words tells quotation (quotation marks on both sides, words of reporting) from abuse
(words of address). The weights of exact and misspelled, quoted and unquoted hits go into a logistic model. It is fitted on
training rows that each were read with a lexicon learned without their own fold (cross-fitting), so that a term that is
toxic by chance earns no trust.

Labels come only from rows of training folds, at most FIT_ROWS (a documented bound); labels, lang, source and doc_id never
enter a score, so equal texts have equal scores, and every text is scored whole. Defined results: null texts are
empty; texts without hits, empty ones too, share one score; with no labelled rows or one class the score is the
mean label, or 0.5; repeated rows give a row each; other columns are passed over, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, text_batches
from .labels import fit_sample, fold
from .shingles import Shingler, min_hashes, mix

FIT_ROWS = 40_000
#: Terms at most (the size of the automaton; those with most evidence first), lengths of stems, words of context, folds of
#: the cross-fitting, letters from which two edits are allowed.
TERMS, STEM, WINDOW, CROSS, LONG = 4096, (4, 9), 6, 4, 9
#: A term is tried if it is in so many training texts, and taken if chance puts any tried term into as many toxic ones
#: with no more than this probability.
LEAST_DOCS, CHANCE = 3, 0.05
#: Signs that stand for letters.
LEET = str.maketrans("013457@$", "oieastas")
_TOKEN = re.compile(r"[\"“”«»„]|[^\W_]+(?:[@$'][^\W_]+)*")
_QUOTE = frozenset("\"“”«»„")
#: Words of reporting and of address, in the languages at hand.
REPORTING = frozenset("said says called calls wrote quoted quote word term slur sagte nannte wort dit mot dijo palabra".split())
ADDRESS = frozenset("you your youre du dein dich ihr tu toi vous ton te usted tus".split())


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def plain(token: str) -> str:
    """A token with signs for letters read as letters; numbers stay as they are."""
    return token if token.isalpha() or token.isdigit() else token.translate(LEET)


class Automaton:
    """Levenshtein automata of all terms over their trie. A term that ends in * is a stem: it accepts, without
    edits, whatever goes on from it. A state is a set of (node, edits, letter): a letter that is not "" must come next, as
    the first of two that changed places."""

    def __init__(self, terms: list[str], weights: list[float] | None = None, short: int = 5, long: int = LONG):
        self.children: list[dict[str, int]] = [{}]
        self.term: dict[int, int] = {}
        self.stem: dict[int, int] = {}
        self.edits: list[int] = [0]
        self.terms, self.weights = terms, weights or [1.0] * len(terms)
        self.most: dict[int, int] = {}
        for k, term in enumerate(terms):
            stem = term.endswith("*")
            most = 0 if stem else (len(term) >= short) + (len(term) >= long)
            node = 0
            self.edits[0] = max(self.edits[0], most)
            for c in term.removesuffix("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.edits.append(0)
                node = self.children[node][c]
                self.edits[node] = max(self.edits[node], most)
            if stem:
                self.stem[node] = k
            else:
                self.term[node], self.most[node] = k, most
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.final: list[tuple[int, int] | None] = []
        self.absorbing: list[int | None] = []
        self.start = self._state({(0, 0, "")})
        self.known: dict[str, tuple[int, int] | None] = {}

    def _state(self, parts: set) -> int:
        """The state of these (node, edits, letter) and of those that letters left out lead to."""
        todo, closed = list(parts), set(parts)
        while todo:
            node, e, wait = todo.pop()
            for child in () if wait else self.children[node].values():
                if e + 1 <= self.edits[child] and (child, e + 1, "") not in closed:
                    closed.add((child, e + 1, ""))
                    todo.append((child, e + 1, ""))
        key = frozenset(p for p in closed if not any((p[0], e, p[2]) in closed for e in range(p[1])))
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            ends = [(e, self.term[n]) for n, e, wait in key if not wait and n in self.term and e <= self.most[n]]
            self.final.append(min(ends, default=None))
            self.absorbing.append(min((self.stem[n] for n, e, wait in key if not wait and n in self.stem and e == 0), default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        after = set()
        for node, e, wait in self.sets[state]:
            if wait:
                if c == wait:
                    after.add((node, e, ""))
                continue
            children = self.children[node]
            if c in children:
                after.add((children[c], e, ""))
            if e + 1 <= self.edits[node]:
                after.add((node, e + 1, ""))  # a letter too many
            for other, child in children.items():
                if e + 1 <= self.edits[child]:
                    after.add((child, e + 1, ""))  # another letter
                    swapped = self.children[child].get(c)
                    if swapped is not None and other != c and e + 1 <= self.edits[swapped]:
                        after.add((swapped, e + 1, other))
        found = self.steps[state][c] = self._state(after) if after else -1
        return found

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, term number) of the nearest term; of a stem if no term is the word itself; or None."""
        state, steps, stem = self.start, self.steps, None
        for c in word:
            after = steps[state].get(c)
            state = self._step(state, c) if after is None else after
            if state < 0:
                return None if stem is None else (0, stem)
            if self.absorbing[state] is not None:
                stem = self.absorbing[state]  # the longest one that the word begins with
        near = self.final[state]
        return near if stem is None or (near is not None and near[0] == 0) else (0, stem)

    def __call__(self, token: str) -> tuple[int, int] | None:
        if token not in self.known:
            if len(self.known) > 300_000:
                self.known.clear()
            self.known[token] = self.find(plain(token)) if len(token) > 2 else None
        return self.known[token]


def quoted(tokens: list[str], at: int, window: int) -> float:
    """Over 0: the hit at this place is rather quoted than meant."""
    before, after = tokens[max(0, at - window) : at], tokens[at + 1 : at + 1 + window]
    score = 0.0
    if not _QUOTE.isdisjoint(before) and not _QUOTE.isdisjoint(after):
        score += 1.0
    score += 0.6 * (not REPORTING.isdisjoint(before))
    return score - 0.5 * (not ADDRESS.isdisjoint(before + after))


COUNTS = ["exact", "fuzzy", "quoted", "distinct_terms"]


def hits(tokens: list[str], find: Automaton, window: int = WINDOW) -> tuple[int, int, int, int, float, float, float]:
    """How many hits there are: exact unquoted, misspelled unquoted, quoted, distinct terms; and the weights of the distinct
    terms among the first three."""
    terms = {t: f for t in set(tokens) if (f := find(t)) is not None}
    if not terms:
        return 0, 0, 0, 0, 0.0, 0.0, 0.0
    counts: tuple[Counter, Counter, Counter] = Counter(), Counter(), Counter()
    for at, t in enumerate(tokens):
        if (f := terms.get(t)) is not None:
            kind = 2 if quoted(tokens, at, window) > 0 else 0 if f[0] == 0 and plain(t) == t else 1
            counts[kind][f[1]] += 1
    return (*(c.total() for c in counts), len({f[1] for f in terms.values()}), *(sum(find.weights[k] for k in c) for c in counts))


def inputs(counted: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Model inputs of hits' rows and the texts' numbers of tokens; all 0 without hits."""
    weight, any_ = counted[:, 4:7], counted[:, 3:4] > 0
    return np.hstack([np.log1p(weight), weight > 0, any_ * np.log1p(counted[:, 3:4]), any_ * np.log1p(sizes[:, None])]).astype(float)


def without_copies(train: DataFrame, seeds: int = 2) -> DataFrame:
    """doc_id and label of train (doc_id, text, label), one for each group of near copies: of the rows that share a
    minimum hash of their five-word shingles, the smallest doc_id stays. Copies of one text are no evidence."""

    def sign(batches):
        shingler, marks = Shingler(5), mix(np.arange(1, seeds + 1, dtype=np.uint64))
        for batch in batches:
            sets = shingler.sets(batch.column(1).to_pylist())
            least = np.array([min_hashes(s, marks) if len(s) else np.zeros(seeds, np.uint64) for s in sets], np.uint64).reshape(-1, seeds).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(np.ascontiguousarray(least[:, k])) for k in range(seeds))], names=["doc_id", "label", *(f"h{k}" for k in range(seeds))])

    signed = train.select("doc_id", "text", "label").mapInArrow(sign, "doc_id long, label int, " + ", ".join(f"h{k} long" for k in range(seeds)))
    for k in range(seeds):
        signed = signed.groupBy(f"h{k}").agg(F.min(F.struct("doc_id", "label", *(f"h{j}" for j in range(seeds) if j != k))).alias("x")).select("x.*", f"h{k}")
    return signed.select("doc_id", "label")


def term_counts(train: DataFrame) -> DataFrame:
    """For each word and stem (with *) of train (doc_id, text, label): n0, toxic0 .. of each fold of the cross-fitting, the
    texts and toxic texts that hold it."""

    def count(batches):
        for batch in batches:
            all_: list[Counter] = [Counter() for _ in range(2 * CROSS)]
            for text, label, part in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                words = {plain(t) for t in tokens_of(text) if len(t) > 3}
                found = words | {w[:k] + "*" for w in words for k in range(STEM[0], min(STEM[1], len(w)))}
                all_[2 * part].update(found)
                if label:
                    all_[2 * part + 1].update(found)
            terms = list(set().union(*all_))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in all_)], names=["term", *FOLD_COUNTS])

    part = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(CROSS)).cast("int")
    counted = train.select("text", "label", part.alias("part")).mapInArrow(count, "term string, " + ", ".join(f"{c} long" for c in FOLD_COUNTS))
    return counted.groupBy("term").agg(*(F.sum(c).alias(c) for c in FOLD_COUNTS))


FOLD_COUNTS = [f"{c}{k}" for k in range(CROSS) for c in ("n", "toxic")]


def evidence(n, toxic, base: float):
    """n times the relative entropy of toxic / n to base: exp of its negative bounds how likely chance alone puts the term
    into so many toxic texts of n (Chernoff)."""
    share = toxic / n
    one = F.when(share > 0, share * F.log(share / base)).otherwise(0.0)
    two = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0)
    return F.when(share > base, n * (one + two)).otherwise(0.0)


def chosen_terms(rows: list[tuple[str, int, int]], totals: tuple[int, int]) -> tuple[list[str], list[float]]:
    """Terms and weights of (term, n, toxic): a stem that one word makes up, or that a shorter chosen stem says as well, is
    left out. totals: texts and toxic texts in all."""
    toxic = {t: b for t, _, b in rows}
    stems: list[str] = []
    best: dict[str, int] = {}
    for t, b in toxic.items():
        if not t.endswith("*"):
            for k in range(STEM[0], min(STEM[1], len(t)) + 1):
                best[t[:k]] = max(best.get(t[:k], 0), b)
    share = {t: b / n for t, n, b in rows}
    for stem in sorted((t for t in toxic if t.endswith("*")), key=lambda t: (len(t), t)):
        above = [stem[:k] + "*" for k in range(STEM[0], len(stem) - 1)]
        if best.get(stem[:-1], 0) < 0.6 * toxic[stem] and not any(a in stems and share[a] >= 0.9 * share[stem] for a in above):
            stems.append(stem)
    kept = set(stems)
    out = [(t, n, b) for t, n, b in rows if not t.endswith("*") or t in kept]
    odds = lambda n, b: float(np.log((b + 0.5) / (totals[1] + 1)) - np.log((n - b + 0.5) / (totals[0] - totals[1] + 1)))
    weighed = [(t, w) for t, n, b in out if (w := odds(n, b)) > 0]
    return [t for t, _ in weighed], [w for _, w in weighed]


def learn_lexicon(counted: DataFrame, totals: list[tuple[int, int]], without: int | None = None, terms: int = TERMS) -> tuple[list[str], list[float]]:
    """Terms and their weights by the folds of counted but one. totals: texts and toxic texts of each fold."""
    folds = [k for k in range(CROSS) if k != without]
    size, ones = (sum(totals[k][j] for k in folds) for j in (0, 1))
    if not 0 < ones < size:
        return [], []
    summed = counted.select("term", sum((F.col(f"n{k}") for k in folds), F.lit(0)).alias("n"), sum((F.col(f"toxic{k}") for k in folds), F.lit(0)).alias("toxic")).where(F.col("n") >= LEAST_DOCS)
    tried = summed.count()
    taken = summed.withColumn("e", evidence(F.col("n"), F.col("toxic"), ones / size)).where(F.col("e") >= float(np.log(max(1, tried) / CHANCE)))
    return chosen_terms([(r.term, r.n, r.toxic) for r in taken.orderBy(F.desc("e"), "term").limit(terms).collect()], (size, ones))


def logistic(x: np.ndarray, n: np.ndarray, ones: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a ridge logistic fit on counted rows, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 0.01
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + penalty, x.T @ (ones - n * p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


MODEL = "exact int, fuzzy int, quoted int, distinct_terms int"


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, label: str = "toxic", fit_rows: int = FIT_ROWS, window: int = WINDOW) -> DataFrame:
    """doc_id, held_out, score and the hit counts of each row of docs. Rows of fold `held` (crc32 of doc_id
    modulo `folds`) lend no labels."""
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held_out = (fold("doc_id", folds) == held).alias("held_out")
    sample = stored(fit_sample(docs, labels, label, fold("doc_id", folds) != held, fit_rows), "labelled")
    sample = stored(without_copies(docs.join(F.broadcast(sample), "doc_id")), "sample")
    parts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    train = stored(docs.join(F.broadcast(sample), "doc_id").repartition(parts, "doc_id", "text").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(CROSS)).cast("int")), "train")  # fit_rows bounds both
    sums = {r.part: (r.n, r.ones) for r in train.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).collect()}
    totals = [sums.get(k, (0, 0)) for k in range(CROSS)]
    size, ones = sum(t[0] for t in totals), sum(t[1] for t in totals)
    if not 0 < ones < size:
        rate = F.lit(0.5 if not size else ones / size)
        return docs.select("doc_id", held_out, rate.alias("score"), *(F.lit(0).alias(c) for c in COUNTS))
    counted = stored(term_counts(train), "terms")
    lexicons = [learn_lexicon(counted, totals, k) for k in (*range(CROSS), None)]
    spread = spark.sparkContext.broadcast(lexicons)  # CROSS + 1 times TERMS words at most

    def read(texts, of):
        """hits' rows of texts with the automata `of`, and the texts' sizes."""
        rows, sizes = [], []
        for text, find in zip(texts, of, strict=True):
            tokens = tokens_of(text)
            rows.append(hits(tokens, find, window))
            sizes.append(len(tokens))
        return np.array(rows, float).reshape(-1, 7), np.array(sizes, float)

    def read_train(batches):
        finds = [Automaton(*x) for x in spread.value[:CROSS]]
        for batch in batches:
            x = inputs(*read(batch.column(0).to_pylist(), [finds[k] for k in batch.column(2).to_pylist()]))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1)], names=["x", "label"])

    seen = train.select("text", "label", "part").mapInArrow(read_train, "x array<double>, label int").toArrow()  # fit_rows bounds it
    x, y = np.array(seen.column("x").to_pylist(), float), seen.column("label").to_numpy().astype(float)
    weights = logistic(x, np.ones(len(y)), y)

    def score(batches):
        find = Automaton(*spread.value[CROSS])
        for batch in batches:
            rows, sizes = read(batch.column(1).to_pylist(), [find] * batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(inputs(rows, sizes) @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64()), *(pa.array(rows[:, k].astype(np.int32)) for k in range(4))], names=["doc_id", "score", *COUNTS])

    return docs.mapInArrow(score, f"doc_id long, score double, {MODEL}").select("doc_id", held_out, "score", *COUNTS)
