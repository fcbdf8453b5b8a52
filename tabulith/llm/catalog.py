"""The registered queries of the corpus operators and the SQL they must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate, language, near_dup, packing, periodic_runs, pii, secrets, suffix_dedup, suffix_tree_lm, topk, toxicity, url_filter,
    vector_codes,
)
from .rows import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def digest(text) -> F.Column:
    return F.sha2(text, 256)


@query
def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", gone.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), digest("kept").alias("kept_sha256"),
    )


@query
def op2_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    found = decontaminate.judge(decontaminate.find_matches(table(spark, sf, "documents"), table(spark, sf, "benchmark")))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        digest(F.array_join("items", ",")).alias("items_sha256"), "contaminated",
    )


@query
def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.withColumn("base", base).select(
        F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        digest(secrets.named("base")).alias("base_sha256"), secrets.named("spans").alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
    )


#: Domain rules of the URL contract.
DOMAINS = [
    url_filter.DomainRule("block", "net", "/"), url_filter.DomainRule("allow", "example.net", "/en/"),
    url_filter.DomainRule("block", "example.com", "/de/"), url_filter.DomainRule("allow", "org", "/fr/"),
]
#: Pattern rules for pages that no domain rule decides.
PATTERNS = [
    url_filter.PatternRule("block", "[?&]utm_source=feed(&|#|$)"), url_filter.PatternRule("block", "[?&]page=\\d+"),
    url_filter.PatternRule("block", "^https?://m\\."), url_filter.PatternRule("block", "/login[/?#]"),
    url_filter.PatternRule("block", "/cart[/?#]"), url_filter.PatternRule("block", "[?&]sessionid="),
    url_filter.PatternRule("block", "\\.(pdf|zip|exe)([?#]|$)"), url_filter.PatternRule("allow", "/en/\\d+\\.html$"),
]


@query
def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    judged = url_filter.filter_urls(table(spark, sf, "pages"), PATTERNS, DOMAINS)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "matched")


def _hits(action: str) -> str:
    found = [f"CAST(regexp_matches(low, '{r.pattern}') AS BIGINT)" for r in PATTERNS if r.action == action]
    return " + ".join(found) or "0"


SQL["op4_url_filter"] = f"""
WITH a AS (
  SELECT page_id, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (
  SELECT page_id, coalesce(low, '') AS low,
    coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM b),
r AS (
  SELECT * FROM (VALUES {", ".join(f"('{d.host}', '{d.path}', '{d.name}', '{d.action}')" for d in DOMAINS)}) t(h, p, name, action)),
d AS (
  SELECT c.page_id, max(struct_pack(n := length(name), name := name, action := action)) AS best
  FROM c JOIN r ON (c.host = h OR ends_with(c.host, '.' || h)) AND starts_with(c.path, p) GROUP BY 1),
e AS (
  SELECT page_id, {_hits("block")} AS blocked, {_hits("allow")} AS spared FROM c)
SELECT c.page_id, c.host, c.path, d.best.name AS rule,
  coalesce(d.best.action, CASE WHEN blocked > 0 AND spared = 0 THEN 'block' ELSE 'allow' END) AS verdict,
  blocked + spared AS matched
FROM c JOIN e ON c.page_id = e.page_id LEFT JOIN d ON c.page_id = d.page_id"""


@query
def op5_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return topk.top_k(vectors, vectors["vec_id"] % 100 == 0)


SQL["op5_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(1024 * x) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM k WHERE rank <= 10"""


@query
def op6_ngram_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    groups = near_dup.near_duplicate_groups(table(spark, sf, "documents"), width=4, numer=85, denom=100)
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


SQL["op6_ngram_jaccard"] = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 4 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: list_aggregate(w[i : i + 3], 'string_agg', ' ')) END) AS g
  FROM w WHERE w IS NOT NULL),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (
  SELECT doc_id AS v, doc_id AS c FROM documents
  UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT v, min(c) AS c FROM r GROUP BY 1) m ON m.v = d.doc_id"""


def fold(parts: int) -> F.Column:
    """True for the held-out fold: CRC-32 of the id as text leaves 2."""
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts == 2


@query
def op7_suffix_tree_lm(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = suffix_tree_lm.SuffixTreeModel(docs, ~fold(7))
    return model.score(docs).withColumnRenamed("id", "doc_id").select(
        "doc_id", fold(7).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score",
    )


@query
def op8_pii_boosting(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    likely = F.transform("added", lambda s: F.struct(F.lit(4).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return found.select(
        F.col("id").alias("doc_id"), *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])],
        digest(pii.named(F.array_sort("base"))).alias("base_sha256"), pii.named(F.array_sort(F.concat("base", likely))).alias("spans"),
    )


@query
def op9_language_crf(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    field = language.fit_field(docs, ~fold(4))
    return language.predict_language(docs, field).withColumnRenamed("id", "doc_id").select(
        "doc_id", fold(4).alias("held_out"), F.col("lang").alias("lang_pred"), "score"
    )


@query
def op10_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(table(spark, sf, "documents"))
    return packed.select(F.col("id").alias("doc_id"), "piece", "start", "n_tokens", "bin", "offset", "capacity", "bin_tokens")


def periodic_texts(docs: DataFrame) -> DataFrame:
    """The documents with the periods of the contract planted in a tenth of them."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    a = g % n
    period = 1 + F.floor((n - a) / (3 + g % 8))
    planted = F.transform(
        F.sequence(F.lit(0), n - 1), lambda i: F.col("words")[F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")]
    )
    chosen = (F.col("h") % 10 == 0) & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return docs.select("doc_id", "text", h.alias("h")).withColumn(
        "words", F.when((F.col("h") % 10 == 0) & F.col("text").isNotNull(), words)
    ).withColumn("n", F.coalesce(n, F.lit(0))).withColumn("a", F.when(F.col("n") > 0, a)).withColumn("p", F.when(F.col("n") > 0, period)).select(
        "doc_id", F.when(chosen, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text")
    )


@query
def op11_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    found = periodic_runs.find_runs(periodic_texts(table(spark, sf, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"], r["period"])))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"),
        (-F.col("best.length")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        digest(F.array_join(listed, "")).alias("runs_sha256"), digest("kept").alias("collapsed_sha256"),
    )


@query
def op12_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded, books = vector_codes.encode(table(spark, sf, "embeddings"))
    return vector_codes.labelled_error(coded).select(
        F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error",
        F.lit(books.digest() if books else None).cast("string").alias("codebooks_sha256"),
    )


def _rounds(parts: int = 8, rounds: int = 6) -> str:
    """Assignments and new entries of every round, as a chain of tables."""
    out = []
    for r in range(rounds + 1):
        out.append(f"""
a{r} AS MATERIALIZED (
  SELECT p.vec_id, p.label, p.part, any_value(p.e) AS e,
    min(list_sum(list_transform(range(1, len(p.e) + 1), lambda i: (p.e[i] - b.e[i]) * (p.e[i] - b.e[i]))) * 16 + b.entry) AS best
  FROM p JOIN b{r} b ON b.part = p.part GROUP BY 1, 2, 3)""")
        if r < rounds:
            out.append(f"""
m{r} AS (
  SELECT part, entry, list(x ORDER BY i) AS e FROM (
    SELECT part, best % 16 AS entry, i, CAST(floor(sum(e[i]) / count(*)) AS BIGINT) AS x
    FROM a{r}, range(1, (SELECT max(len(e)) + 1 FROM p)) g(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{r + 1} AS MATERIALIZED (
  SELECT o.part, o.entry, coalesce(m.e, o.e) AS e FROM b{r} o LEFT JOIN m{r} m ON m.part = o.part AND m.entry = o.entry)""")
    return ",".join(out)


SQL["op12_vector_codes"] = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(floor(4096 * x) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT vec_id, label, part, e[part * (len(e) // 8) + 1 : (part + 1) * (len(e) // 8)] AS e FROM v, range(8) t(part)),
b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, e FROM p
  WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 16)),{_rounds()},
c AS (
  SELECT vec_id, label, string_agg(printf('%02x', CAST(best % 16 AS INTEGER)), '' ORDER BY part) AS code,
    CAST(sum(best // 16) AS BIGINT) AS error FROM a6 GROUP BY 1, 2),
d AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, i)) AS d
  FROM (SELECT part, entry, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM b6))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, d AS codebooks_sha256 FROM c, d"""


@query
def op13_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    fitted = toxicity.fit_toxicity(docs, labels, ~fold(4))
    scored = toxicity.score_toxicity(docs, fitted).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", fold(4).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
