"""The registered queries against SQL and plain versions on the small tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute  # noqa: E402
from compare import TABLES, compare  # noqa: E402

from tabulith.llm import llm_queries, llm_sql  # noqa: E402

Q, SQL = llm_queries(), llm_sql()


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = compare(Q[name](spark, sf).toPandas(), con.execute(SQL[name]).df())
    assert result.startswith("ok"), result


def test_repeats(spark, sf, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in Q["op1_suffix_dedup"](spark, sf).collect()}
    assert got == brute.repeats(docs)


def test_contamination(spark, sf, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in Q["op2_decontaminate"](spark, sf).collect()}
    want = brute.contamination(docs, items)
    assert got == want and any(v[4] for v in want.values())


def test_secrets(spark, sf, docs):
    want = {d: brute.secret_spans(t) for d, t in docs}
    for r in Q["op3_secret_scan"](spark, sf).collect():
        w = want[r.doc_id]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, *_ in w) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == brute.sha(brute.joined(w))
        assert {brute.joined([s]) for s in w} <= set(r.spans.split(",")) | {""}


def test_unigrams(spark, sf, docs):
    want = brute.unigram_scores(docs)
    rows = Q["op7_suffix_tree_lm"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_personal_data(spark, sf, docs):
    want = {d: brute.personal_spans(t) for d, t in docs}
    for r in Q["op8_pii_boosting"](spark, sf).collect():
        w = want[r.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, *_ in w) for x in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == brute.sha(brute.joined(w))
        assert {brute.joined([s]) for s in w} <= set(r.spans.split(",")) | {""}


def test_language(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in Q["op9_language_crf"](spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_packing(spark, sf, docs):
    rows = Q["op10_best_fit_packing"](spark, sf).collect()
    total, bins = {}, {}
    for r in rows:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    for d, t in docs:
        n = len((t or "").split())
        assert total[d] == (n + 1 if n else 0)
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.n_tokens
        assert at == own[0].bin_tokens <= own[0].capacity in (512, 1024, 2048, 4096)
