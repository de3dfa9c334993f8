"""The queries that have SQL against DuckDB, over tables of odd rows that the supplied ones lack."""

import duckdb
import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from fieldmend.llm import jaccard, queries, sql  # noqa: E402

IBAN, TOKEN = "DE89370400440532013000", "2321bac4d15ec8f90433955bf9d3cf61da5bdd1e"
TEXTS = [
    None, "", " ", "\n\n\n", f"pay to iban {IBAN} NOW", "GB82 WEST 1234 5698 7654 32 and DE89370400440532013001", f"order {IBAN}", "ssn 123-45-6789", "123-45-6789", "social security 123-45-6789-1 and 1123-45-6789, tax 078-05-1120.",
    "ssn 000-12-3456 ssn 123-45-6789 tax 123-45-6780", f'token = "{TOKEN}"', f"build {TOKEN}", f"key: {'a1' * 20} and secret {TOKEN.upper()}_x", "mail a@b.c.d, a@b.c@d.e card 4111 1111 1111 1111 or 4111111111111112 +1 (017) 555-7713 from 1.2.3.4 300.1.1.1",
    "é𝒳ü a@b.c 𝒳 10.0.0.1", "One two three four five six seven eight nine ten eleven", "zero one two three four five six seven eight nine ten eleven twelve", "Ünï cöde", "A  b", "a b c", "a b c d e", "a b c d e", "l1\nl2\nl3\nl4", "x\nl1\nl2\nl3\ny",
    "a\na\na\na\nb", "word " * 30_000, "line\n" * 500,
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    rng = np.random.default_rng(3)
    near = ["w" + " w".join(map(str, rng.integers(0, 40, 40))) for _ in range(12)]
    near += [" ".join([*t.split()[:-1], "x"]) for t in near[:6]]
    docs = [(k, t, k, [None, "", "s", "t"][k % 4]) for k, t in enumerate(TEXTS + near)]
    known = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 40, 2)] + [(3, None, 1), (4, 1, 1), (None, 1, 1), (999, 1, 1)]
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, n long, source string").coalesce(2).write.parquet(f"{at}/documents.parquet")
    items = [(1, TEXTS[16]), (2, "b c"), (3, None), (4, "..."), (None, "c d e"), (5, "cöde"), (2, "b c")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{at}/benchmark.parquet")
    pages = [(k, f"http://h{k % 3}.org/{k}", t) for k, t in enumerate(TEXTS + ["p" * 1000] * 3 + ["p" * 999] * 2)] + [(-1, None, "q" * 2000), (77, "http://[bad", "q" * 2000)]
    spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2).write.parquet(f"{at}/pages.parquet")
    return at


def rows(found):
    names = sorted(found[0]) if found else []
    return sorted(repr([r[c] for c in names]) for r in found)


@pytest.mark.parametrize("name", sorted(sql.SQL))
def test_query_equals_sql(spark, folder, name, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_IDS", 0)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = con.execute(sql.SQL[name])
    names = [c[0] for c in want.description]
    want = [dict(zip(names, r, strict=True)) for r in want.fetchall()]
    got = [r.asDict() for r in queries.QUERIES[name](spark, folder).collect()]
    assert len(got) == len(want) > 0 and sorted(got[0]) == sorted(names)
    for a, b in zip(rows(got), rows(want), strict=True):
        assert a == b


def test_every_kind_is_found(spark, folder):
    out = queries.op2_pii(spark, folder).selectExpr("sum(n_email) email", "sum(n_ip) ip", "sum(n_card) card", "sum(n_phone) phone", "sum(n_iban) iban", "sum(n_ssn) ssn", "sum(n_secret) secret").first()
    assert all(v > 0 for v in out) and out.iban == 2 and out.ssn == 4 and out.secret == 2
