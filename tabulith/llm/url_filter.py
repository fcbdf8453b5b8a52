"""URL filter: pattern rules found through their rarest literal token.

Every rule that must contain a whole alphanumeric token is filed under the token
that is rarest in the URLs at hand.  The tokens of a URL fetch candidate rules by
an equi-join, and only those run their regular expression.  Rules without such a
token are tried on every URL.  Everything is a DataFrame expression.

Null or empty URLs have no token and no host; they match no rule.  Repeated page
ids are separate rows.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import keyed

#: Rule tables up to this many rows are broadcast, larger ones are shuffled.
BROADCAST_RULES = 50_000


@dataclass(frozen=True)
class PatternRule:
    """A regular expression on the lower-cased URL; an allow rule beats a block rule."""

    action: str
    pattern: str


@dataclass(frozen=True)
class DomainRule:
    """A host with its subdomains and a path prefix."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def literal_tokens(pattern: str) -> list[str]:
    """Alphanumeric tokens that every match of ``pattern`` contains as a whole token.

    Only the top level is read.  A run of literal letters and digits counts if both
    neighbours are anchors, literal separators or classes of separators only.
    """
    edge, other, symbols, i = "|", "~", [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            n = pattern[i + 1]
            symbols.append(n if n.isdigit() else other if n.isalpha() else edge)
            i += 2
        elif c == "[":
            j = pattern.index("]", i + 2)
            body = pattern[i + 1 : j]
            plain = not body.startswith("^") and not any(x.isalnum() for x in body) and "\\" not in body and "-" not in body[1:-1]
            symbols.append(edge if plain else other)
            i = j + 1
        elif c == "(":
            depth, j = 1, i + 1
            while depth:
                depth += {"(": 1, ")": -1}.get(pattern[j], 0) if pattern[j - 1] != "\\" else 0
                j += 1
            symbols.append(other)
            i = j
        elif c == "|":
            return []
        elif c in "?*+{":
            j = pattern.index("}", i) if c == "{" else i
            symbols[-1] = other
            i = j + 1
        else:
            symbols.append(c if c.isascii() and c.isalnum() else other if c == "." else edge)
            i += 1
    symbols = [other, *symbols, other]
    if pattern.startswith("^"):
        symbols[0] = edge
    if pattern.endswith("$"):
        symbols[-1] = edge
    found, run = [], ""
    for before, s in zip(symbols, symbols[1:]):
        if len(s) == 1 and s.isalnum():
            run = run + s if run else (s if before == edge else "")
        else:
            if run and s == edge:
                found.append(run.lower())
            run = ""
    return sorted(set(found))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_RULES else df


def rule_index(urls: DataFrame, rules: list[PatternRule]) -> list[tuple[str | None, int]]:
    """``(token, rule number)``: each rule under its token with the fewest URLs.

    ``urls`` has ``tokens``.  One aggregate over all URLs counts the tokens that
    occur in rules; ties go to the smaller token.
    """
    own = [literal_tokens(r.pattern) for r in rules]
    wanted = sorted({t for ts in own for t in ts})
    counts: dict[str, int] = {}
    if wanted:
        spark = urls.sparkSession
        names = _small(spark.createDataFrame([(t,) for t in wanted], "token string"), len(wanted))
        seen = urls.select(F.explode("tokens").alias("token")).join(names, "token").groupBy("token").count()
        counts = {r["token"]: r["count"] for r in seen.collect()}
    return [
        (min(ts, key=lambda t: (counts.get(t, 0), t)) if ts else None, i) for i, ts in enumerate(own)
    ]


def filter_urls(
    pages: DataFrame, rules: list[PatternRule], domains: list[DomainRule], id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per page: ``id, host, path, rule, verdict, matched, candidates``.

    ``rule`` is the longest fitting domain rule and decides ``verdict``; without
    one, a page is blocked if a block pattern matches and no allow pattern does.
    ``candidates`` counts the pattern rules fetched, ``matched`` those that matched.
    """
    spark = pages.sparkSession
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = F.translate(F.col("url"), upper, lower)
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.col("url").substr(at + 3, F.length("url")))
    urls = keyed(pages, id_col, url=pages[url_col].cast("string"))
    urls = urls.withColumn("low", low).withColumn(
        "tokens", F.array_remove(F.array_distinct(F.split(F.coalesce("low", F.lit("")), "[^a-z0-9]+")), "")
    ).withColumn("rest", F.coalesce(rest, F.lit("")))
    urls = urls.withColumn("raw", F.regexp_extract("rest", "^[^/?#]*", 0)).withColumn(
        "path", F.regexp_extract(F.col("rest").substr(F.length("raw") + 1, F.length("rest")), "^[^?#]*", 0)
    ).withColumn("host", F.translate("raw", upper, lower)).select("rid", "id", "low", "tokens", "host", "path")

    result = urls
    if domains:
        labels = max(d.host.count(".") + 1 for d in domains)
        table = spark.createDataFrame([(d.host, d.path, d.name, d.action) for d in domains], "suffix string, start string, rule string, action string")
        ends = [F.substring_index("host", ".", -n) for n in range(1, labels + 1)]
        fits = urls.where("host <> ''").select("rid", "path", F.explode(F.array_distinct(F.array(*ends))).alias("suffix")).join(
            _small(table, len(domains)), "suffix"
        ).where(F.col("path").startswith(F.col("start")))
        best = fits.groupBy("rid").agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "action")).alias("best"))
        result = result.join(best.select("rid", "best.rule", "best.action"), "rid", "left")
    else:
        result = result.withColumn("rule", F.lit(None).cast("string")).withColumn("action", F.lit(None).cast("string"))

    index = rule_index(urls, rules)
    filed = [(t, i, rules[i].action, f"{rules[i].pattern}") for t, i in index if t is not None]
    tried = []
    if filed:
        rows = spark.createDataFrame(filed, "token string, number int, kind string, pattern string")
        tried.append(
            urls.select("rid", "low", F.explode("tokens").alias("token")).join(_small(rows, len(filed)), "token")
            .select("rid", "kind", F.expr("low rlike pattern").alias("hit"))
        )
    for _, i in [x for x in index if x[0] is None]:
        tried.append(urls.where(F.col("low").isNotNull()).select(
            "rid", F.lit(rules[i].action).alias("kind"), F.col("low").rlike(rules[i].pattern).alias("hit")))
    if tried:
        union = tried[0]
        for t in tried[1:]:
            union = union.unionByName(t)
        hits = union.groupBy("rid").agg(
            F.count(F.lit(1)).alias("candidates"), F.count_if("hit").alias("matched"),
            F.coalesce(F.bool_or(F.expr("hit and kind = 'allow'")), F.lit(False)).alias("spared"),
        )
        result = result.join(hits, "rid", "left")
    else:
        result = result.withColumn("candidates", F.lit(0)).withColumn("matched", F.lit(0)).withColumn("spared", F.lit(False))
    matched = F.coalesce(F.col("matched"), F.lit(0))
    judged = F.when((matched > 0) & ~F.coalesce("spared", F.lit(False)), "block").otherwise("allow")
    return result.select(
        "id", "host", "path", "rule", F.coalesce("action", judged).alias("verdict"),
        matched.cast("long").alias("matched"), F.coalesce("candidates", F.lit(0)).cast("long").alias("candidates"),
    )
