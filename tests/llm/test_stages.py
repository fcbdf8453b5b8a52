"""Pipeline stages on rows that share an id or have none, and the longest matches."""

import random

import pytest

from tabulith.llm import decontaminate, near_dup, secrets

PASSAGE = " ".join(f"passage{i}" for i in range(40))
KEY = "Zx81mQp7Rt55LkWv2BnHs9Yd"


@pytest.fixture(scope="module")
def shared(spark):
    """Clean and affected rows under one id, and without an id."""
    rows = [(d, t, "s", 5) for d in (7, None) for t in (
        "this text has no secret at all in it", f"begin {KEY}{d} end", PASSAGE + " ending", "a clean document of a few plain words", None, "",
    )]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")


def texts(df):
    return sorted((str(r.doc_id), str(r.text)) for r in df.collect())


def test_every_row_is_masked_by_its_own_spans(shared):
    want = sorted((str(r.doc_id), str(r.text).replace(f"{KEY}{r.doc_id}", "[secret]")) for r in shared.collect())
    assert texts(secrets.redact_secrets(shared, length_col="n_chars")) == want


def test_every_row_is_judged_by_its_own_text(spark, shared):
    items = spark.createDataFrame([(1, PASSAGE), (None, "a clean document of a few plain words")], "item_id long, text string")
    kept = decontaminate.remove_contaminated(shared, items)
    assert texts(kept) == sorted(t for t in texts(shared) if PASSAGE not in t[1])


def test_one_row_of_each_group_stays(spark):
    base = [f"word{i}" for i in range(60)]
    near = " ".join(base + ["one"])
    rows = [(7, near), (7, " ".join(base + ["two"])), (7, "something else entirely here now"), (None, near), (None, "left alone as it is today"), (7, near)]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.text[:9] for r in kept) == ["left alon", "something", "word0 wor"] and len(kept) == 3


def plain_matches(words, item, window):
    """Maximal ``(start, length)`` of words that also stand in the item, by every pair of starts."""
    found = set()
    for s in range(len(words)):
        for p in range(len(item)):
            n = 0
            while s + n < len(words) and p + n < len(item) and words[s + n] == item[p + n]:
                n += 1
            if n >= window:
                found.add((s, s + n))
    return sorted((s, e - s) for s, e in found if not any((a <= s and e <= b) and (a, b) != (s, e) for a, b in found))


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d x y b c d e")], "item_id long, text string")
    got = decontaminate.find_matches(docs, items, window=3).first().matches
    assert sorted((m.start, m.length) for m in got) == [(0, 4), (1, 4)]
    rnd = random.Random(4)
    texts_ = [[rnd.choice("abc" if k % 2 else "abcdefgh") for _ in range(rnd.randrange(5, 60))] for k in range(40)]
    for t in texts_[10:]:
        t[2:2] = texts_[rnd.randrange(10)][rnd.randrange(5):][:15]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts_[10:])], "doc_id long, text string")
    items = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts_[:10])], "item_id long, text string")
    for r in decontaminate.find_matches(docs, items, window=4).collect():
        got = {}
        for m in r.matches:
            got.setdefault(int(m["item"]), []).append((m.start, m.length))
        for k, item in enumerate(texts_[:10]):
            assert sorted(got.get(k, [])) == plain_matches(texts_[10 + r.id], item, 4)


def plain_components(sets, numer=80, denom=100):
    """Smallest id reachable by links of similar sets."""
    ids = sorted(sets)
    own = {i: i for i in ids}

    def root(i):
        while own[i] != i:
            i = own[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and denom * both >= numer * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                own[y] = x
    return {i: root(i) for i in ids}


def plain_masked(docs):
    """``docs``: (id, text, owner); live-looking values replaced, widely copied ones left."""
    spans, owners, repos = {}, {}, {}
    for i, text, owner in docs:
        base = secrets.base_spans(text or "")
        spans[i] = base + secrets.mixed_spans(text or "", base)
        for value in {s[3] for s in spans[i]}:
            owners.setdefault(value, set()).add(owner)
            repos[value] = repos.get(value, 0) + 1
    out = {}
    for i, text, _ in docs:
        parts, at = [], 0
        for s, _, e, value in sorted(spans[i], key=lambda x: (x[0], -x[2])):
            if len(owners[value]) > secrets.MAX_OWNERS or repos[value] > secrets.MAX_REPOS:
                continue
            if s >= at:
                parts += [text[at:s], "[secret]"]
            at = max(at, e)
        out[i] = None if text is None else "".join([*parts, text[at:]])
    return out


def test_pipeline_equals_plain_stages(spark, sf):
    """Each stage on what its predecessor kept, against a plain version of it."""
    import brute
    import corpus_pipeline
    from tabulith.llm import language
    from tabulith.llm.rows import stored

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = [(r.doc_id, r.text, r.source, r.n_chars) for r in docs.collect()]
    guessed = {r.id: r.lang for r in language.predict_language(docs, language.fit_field(docs)).collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
        after[name] = docs
        if name == "packing":
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "language":
            held = [r for r in held if guessed[r[0]] != "und"]
        elif name == "near duplicates":
            words = {r[0]: brute.lower(r[1] or "").split() for r in held}
            sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
            first = plain_components(sets)
            held = [r for r in held if first[r[0]] == r[0]]
        elif name == "decontamination":
            found = brute.contamination([r[:2] for r in held], items)
            held = [r for r in held if not found[r[0]][4]]
        else:
            masked = plain_masked([r[:3] for r in held])
            held = [(i, masked[i], o, n if masked[i] == t else len(masked[i])) for i, t, o, n in held]
        got = sorted((r.doc_id, r.text, r.source, r.n_chars) for r in docs.collect())
        assert got == sorted(held), name
    tokens = {}
    for r in docs.collect():
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.n_tokens
    for i, text, _, _ in held:
        n = len((text or "").split())
        assert tokens[i] == (n + 1 if n else 0)
    assert 0 < len(held) < 200
