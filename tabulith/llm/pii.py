"""Personal data: fixed patterns plus candidates judged by gradient-boosted trees.

Four base patterns with their checks (mail address, network address, payment card,
telephone number) are always kept.  High-recall generators propose further spans,
which may overlap.  Boosted trees score every proposal from its canonical form (mail
sign written out or not, digits without their punctuation) and the characters around
it, so that how a checked span is spelled does not tell it from other spellings.

Checked base spans are the positives, with proposals that pass the loose checks of
their shape behind a cue of it; proposals that fail the loose checks are the negatives.
All other proposals have no label: they are scored, never taught as wrong.  The sample
is drawn per class, and the threshold comes from one aggregate over all scored
proposals with a label.  Everything is DataFrame expressions and library trees; texts
are scanned once and offsets come from the lengths of the pieces between matches.

Null and empty texts have no span.  Repeated rows are separate documents.  Without
proposals of both classes nothing is added.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rows import keyed, stored

KINDS = ("email", "ip", "card", "phone", "likely")
#: Look-behinds and possessive repeats give the same leftmost matches without trying
#: every later start of a long run.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
#: Shorter chains of digits cannot pass; a longer one is one match, as by its rule.
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Proposals: addresses with a written-out sign, grouped digits, dotted numbers.
GENERATORS = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
    r"(?<![0-9+(])[+(]{0,2}[0-9](?:[\x20().-]{0,2}[0-9]){6,40}+(?![0-9])",
    r"(?<![0-9.])[0-9]++(?:\.[0-9]++){2,8}+",
)
CUES = ("mail", "tel", "phone", "call", "fax", "card", "visa", "ip", "host", "contact")
#: Proposals that teach the trees, about; half of each class.
SAMPLE_SPANS = 20_000
PRECISION = 0.9


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _total(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda a, n: a + n)


def spans_of(text: Column, pattern: str) -> Column:
    """``start, end, value`` of all matches, in code points.

    Running sums go by blocks, so that a text with many matches stays cheap.
    """
    block = 128
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    pieces = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))

    def with_sizes(a: Column) -> Column:
        sizes = F.zip_with(a["found"], F.slice(a["gaps"], F.lit(1), F.size(a["found"])), lambda v, g: F.length(v) + F.length(g))
        return F.struct(a["found"].alias("found"), a["gaps"].alias("gaps"), sizes.alias("sizes"))

    def with_blocks(a: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(a["sizes"]) - 1) / block).cast("int"))
        sums = F.transform(numbers, lambda c: _total(F.slice(a["sizes"], c * block + 1, F.lit(block))))
        return F.struct(a["found"].alias("found"), a["gaps"].alias("gaps"), a["sizes"].alias("sizes"), sums.alias("sums"))

    def with_bases(a: Column) -> Column:
        bases = F.transform(a["sums"], lambda s, c: _total(F.slice(a["sums"], F.lit(1), c)))
        return F.struct(a["found"].alias("found"), a["gaps"].alias("gaps"), a["sizes"].alias("sizes"), bases.alias("bases"))

    def placed(a: Column) -> Column:
        def span(v: Column, i: Column) -> Column:
            c = F.floor(i / block).cast("int")
            start = a["bases"][c] + _total(F.slice(a["sizes"], c * block + 1, i - c * block)) + F.length(a["gaps"][i])
            return F.struct(start.alias("start"), (start + F.length(v)).alias("end"), v.alias("value"))

        return F.transform(a["found"], span)

    walked = _let(_let(_let(_let(pieces, with_sizes), with_blocks), with_bases), placed)
    return F.when(text.rlike(pattern), walked).otherwise(empty)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the mod-10 check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, d.try_cast("int")
    ).otherwise(2 * d.try_cast("int") - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def octets(value: Column) -> Column:
    """Whether all dotted parts are at most 255."""
    return F.forall(F.split(value, "\\."), lambda p: F.coalesce(
        (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.right(p, F.lit(4))).try_cast("int") <= 255), F.lit(False)
    ))


def checked(text: Column) -> list[tuple[str, Column]]:
    """The base kinds with their valid spans."""
    n = lambda s: F.length(digits_of(s["value"]))
    return [
        ("email", spans_of(text, EMAIL)),
        ("ip", F.filter(spans_of(text, IP), lambda s: octets(s["value"]))),
        ("card", F.filter(spans_of(text, CARD), lambda s: n(s).between(13, 19) & luhn(digits_of(s["value"])))),
        ("phone", F.filter(spans_of(text, PHONE), lambda s: n(s).between(9, 15))),
    ]


#: Cues of a mail address, a network address and a run of digits.
CUES_OF = (("mail", "contact"), ("ip", "host"), ("tel", "phone", "call", "fax", "card", "visa", "contact"))
AT = r"\x20?[(\[]at[)\]]\x20?"
FEATURES = ["mail", "dotted", "length", "digits", "dots", "letters", "passes", "groups", "open", "close", *[f"cue_{c}" for c in CUES]]


def measured(span: Column, text: Column) -> Column:
    """The features of a proposal as doubles, and ``weak``: whether it passes the loose
    checks of its shape behind a cue (1), passes without (null) or fails (0).
    """
    v = F.regexp_replace(span["value"], AT, "@")
    before = F.lower(F.substring(text, F.greatest(F.lit(1), span["start"] - 23), F.least(F.lit(24), span["start"])))
    after = F.substring(text, span["end"] + 1, F.lit(1))
    mail, dotted = v.contains("@"), v.rlike(r"^[0-9]+(\.[0-9]+){3}$") & octets(v)
    plain = F.when(mail | dotted, v).otherwise(digits_of(v))
    digits, passes = F.length(digits_of(v)), luhn(digits_of(v))
    open_, close = before.rlike("[A-Za-z0-9]$"), after.rlike("[A-Za-z0-9]")
    values = {
        "mail": mail, "dotted": dotted, "length": F.length(plain), "digits": digits,
        "dots": F.length(plain) - F.length(F.translate(plain, ".", "")), "letters": F.length(F.regexp_replace(plain, "[^A-Za-z]", "")),
        "passes": passes, "groups": F.size(F.array_remove(F.split(v, "[^A-Za-z0-9]+"), "")), "open": open_, "close": close,
        **{f"cue_{c}": before.contains(c) for c in CUES},
    }
    sound = F.when(mail, v.rlike(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$")).otherwise(
        dotted | digits.between(9, 15) | (digits.between(13, 19) & passes)
    ) & ~open_ & ~close
    cued = [F.greatest(*[before.contains(c) for c in cues]) for cues in CUES_OF]
    weak = F.when(~sound, F.lit(0.0)).when(F.when(mail, cued[0]).when(dotted, cued[1]).otherwise(cued[2]), F.lit(1.0))
    return F.struct(*[F.coalesce(values[k].cast("double"), F.lit(0.0)).alias(k) for k in FEATURES], weak.alias("weak"))


def scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``rid, id, base, proposals`` of every text, written once."""
    given = keyed(docs, id_col, text=docs[text_col].cast("string")).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")

    def of_kind(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    base = F.concat(*[of_kind(spans, k) for k, (_, spans) in enumerate(checked(text))])
    held = given.withColumn("base", base)
    proposals = F.array_distinct(F.concat(*[spans_of(text, g) for g in GENERATORS]))
    judged = F.transform(proposals, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.exists("base", lambda b: (b["start"] == s["start"]) & (b["end"] == s["end"])).alias("sure"),
        F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])).alias("covered"),
        measured(s, text).alias("x"),
    ))
    return stored(held.select("rid", "id", "base", judged.alias("proposals")), "pii-scan")


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_spans: int = SAMPLE_SPANS, precision: float = PRECISION,
) -> DataFrame:
    """``rid, id, base, added``: checked spans by kind number, and spans the trees add."""
    scanned = scan(docs, id_col, text_col)
    each = scanned.select("rid", F.explode("proposals").alias("p")).select("rid", "p.start", "p.end", "p.sure", "p.covered", "p.x.*")
    label = F.when(F.col("sure"), F.lit(1.0)).when(~F.col("covered"), F.col("weak"))
    ready = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(each).select(
        "rid", "start", "end", "covered", label.alias("label"), "features"
    )
    state = {r["label"]: r["n"] for r in ready.where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    none = F.array().cast("array<struct<start:int,end:int,chance:double>>")
    if len(state) < 2:
        return scanned.select("rid", "id", "base", none.alias("added"))
    draw = F.pmod(F.xxhash64("rid", "start", "end"), F.lit(1_000_000)) / 1_000_000
    share = {k: min(1.0, max(1, sample_spans // 2) / n) for k, n in state.items()}
    teach = stored(ready.where(draw < F.when(F.col("label") == 1, share[1.0]).when(F.col("label") == 0, share[0.0])), "pii-sample")
    if teach.select("label").distinct().count() < 2:
        return scanned.select("rid", "id", "base", none.alias("added"))
    model = GBTClassifier(maxIter=12, maxDepth=4, seed=1).fit(teach)
    chance = vector_to_array("probability")[1]
    bins = model.transform(ready.where("label is not null")).groupBy(F.floor(chance * 100).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")
    ).collect()
    bar, n, good = 2.0, 0, 0.0
    for row in sorted(bins, key=lambda r: -r["bin"]):
        n, good = n + row["n"], good + row["good"]
        if good >= precision * n:
            bar = row["bin"] / 100
    chosen = model.transform(ready.where("not covered")).withColumn("chance", chance).where(F.col("chance") >= bar).groupBy("rid").agg(
        F.sort_array(F.collect_list(F.struct("start", "end", "chance"))).alias("added")
    )
    return scanned.select("rid", "id", "base").join(chosen, "rid", "left").withColumn("added", F.coalesce("added", none))


def named(spans: Column) -> Column:
    """``kind:start:end`` joined by commas, by kind and start."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")
