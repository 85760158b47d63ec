"""Both dedups and the near-duplicate join against brute force."""

import hashlib
from collections import Counter, defaultdict

import pytest

from reelspark.llm import ngram_join, rlz_dedup, suffix_dedup


def removed_bytes(texts, least):
    seen = Counter(b[i : i + least] for b in texts for i in range(len(b) - least + 1))
    out = []
    for b in texts:
        gone = [False] * len(b)
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = [True] * least
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("least,seed,most", [(200, 32, 2000), (40, 12, 2000), (40, 12, 2)])
def test_suffix_dedup(corpus, texts_, least, seed, most):
    want = removed_bytes([(t or "").encode() for t in texts_], least)
    got = suffix_dedup.dedup(corpus, least=least, seed=seed, most=most).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_intervals():
    assert sorted(suffix_dedup.intervals([1, 3, 0, 2])) == [(1, 0, 2), (2, 3, 4), (3, 1, 2)]
    assert list(suffix_dedup.intervals([])) == []


def test_large_groups_list_few_windows(spark, monkeypatch):
    """A passage amid other words, and copies with one word changed: around such seeds a few windows a text are listed, not all of them."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    passage, copy = text(40), text(60)
    texts = [" ".join(text(30) + passage + text(30)) for _ in range(60)]
    for k in range(60):
        at = rng.randrange(60)
        texts.append(" ".join([*copy[:at], word() if k % 3 else f"same{k % 2}", *copy[at + 1 :]]))
    made, plain = spark.sparkContext.accumulator(0), suffix_dedup._windows

    def counted(*args):
        listed = plain(*args)

        def run(batches):
            for batch in listed(batches):
                made.add(batch.num_rows)
                yield batch

        return run

    monkeypatch.setattr(suffix_dedup, "_windows", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.dedup(docs, most=5).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got] == removed_bytes([t.encode() for t in texts], 200)
    assert 0 < made.value < 40 * len(texts)


def test_most_shared_across_ranges(spark):
    """Neighbours may lie in different ranges; there are more ranges here than a range has rows."""
    import random

    rng = random.Random(6)
    rows = [(k % 3, k, bytes(rng.choice(b"ab\xff") for _ in range(rng.randint(0, 8)))) for k in range(90)]
    want = {(s, c): max(suffix_dedup.common_prefix(x, y) for t, d, y in rows if t == s and d != c) for s, c, x in rows}
    had = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = suffix_dedup._most_shared(spark.createDataFrame(rows, "seed long, context long, behind binary"), "behind").groupBy("seed", "context").max("shared").collect()
    finally:
        for c, v in had.items():
            spark.conf.set(c, v)
    assert {(s, c): n for s, c, n in got} == want


def removed_words(texts, window, ids=None):
    """ids: ascending, equal ones are one document to each other."""
    first = {}
    words = [(t or "").encode().split() for t in texts]
    rank = [ids.index(x) for x in ids] if ids else range(len(texts))
    for i, w in enumerate(words):
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), rank[i])
    out = []
    for i, w in enumerate(words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < rank[i]:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window,seed,most", [(13, 4, 500), (6, 2, 500), (6, 2, 1)])
def test_rlz_dedup(corpus, texts_, window, seed, most):
    got = rlz_dedup.dedup(corpus, window=window, seed=seed, most=most).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got] == removed_words(texts_, window)


def brute_components(texts, n, similar):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for t in texts:
        w = (t or "").encode().translate(low).split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= similar * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), top(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("n,similar", [(5, 80), (2, 50)])
def test_near_duplicates(corpus, texts_, n, similar):
    got = ngram_join.near_duplicates(corpus, n=n, similar=similar).orderBy("doc_id").collect()
    want = brute_components(texts_, n, similar)
    assert [(r["n_shingles"], r["component_id"] // 3) for r in got] == want


@pytest.mark.parametrize("n,similar", [(5, 80), (2, 70)])
def test_near_duplicates_of_longer_and_shorter_texts(spark, n, similar):
    """Texts with rare words appended or their tail cut: most of a prefix can be shared beyond the other's prefix."""
    texts = []
    for k, size in enumerate((40, 84, 200)):
        base = [f"w{k}x{i}" for i in range(size)]
        for j, share in enumerate((0.1, 0.18, 0.2, 0.22, 0.24, 0.25)):
            more, less = [f"{w}y{j}" for w in base], [f"{w}z{j}" for w in base]
            texts += [" ".join(more), " ".join(more + [f"own{k}x{j}x{i}" for i in range(int(share * (size - 4)))])]
            texts += [" ".join(less), " ".join(less[: size - int(share * (size - 4))])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = ngram_join.near_duplicates(docs, n=n, similar=similar).orderBy("doc_id").collect()
    assert [(r["n_shingles"], r["component_id"]) for r in got] == brute_components(texts, n, similar)


def test_chains_are_one_component(spark):
    from reelspark.llm._components import components

    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    by = defaultdict(set)
    for r in components(links).collect():
        by[r["component"]].add(r["key"])
    assert by == {0: set(range(1, 41)), 100: {101}}


def test_first_of_each(corpus, odd, shared):
    kept = ngram_join.first_of_each(corpus)
    assert kept.columns == corpus.columns
    want = sorted(r["component_id"] for r in ngram_join.near_duplicates(corpus).select("component_id").distinct().collect())
    assert sorted(r["doc_id"] for r in kept.collect()) == want
    # Under null ids: a text with its near copies, an empty one, a short one. Rows alike in id and text stay once.
    assert sorted(str(r["doc_id"]) for r in ngram_join.first_of_each(odd).collect()) == ["2", "3", "None", "None"]
    rows, docs = shared
    got = [(r["doc_id"], r["text"]) for r in ngram_join.first_of_each(docs).collect()]
    assert len(got) == len(set(got)) and set(got) <= {(i, t) for i, t in rows}
    parts = brute_components([t for _, t in rows], 5, 80)
    stays = {parts[k][1] if parts[k][0] else ("empty", *rows[k]) for k in range(len(rows))}
    assert len(got) == len(stays)  # one row of each group: no row of other text is lost
    index = {t: parts[k][1] for k, (_, t) in enumerate(rows) if parts[k][0]}
    assert {index[t] for _, t in got if t in index} == {p for n, p in parts if n}


@pytest.fixture(scope="module")
def shared(spark, texts_):
    """Ids that are null or stand over several texts, and repeated rows."""
    rows = [(None if i % 3 == 0 else i % 5, t) for i, t in enumerate(texts_)]
    rows += rows[27:31] + [(None, texts_[29])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


def test_rows_that_share_ids(shared):
    rows, docs = shared
    texts = [t for _, t in rows]
    count = lambda values: Counter(map(str, values))
    got = suffix_dedup.dedup(docs, least=60, seed=16).collect()
    assert count((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == count((i, *w) for (i, _), w in zip(rows, removed_bytes([(t or "").encode() for t in texts], 60), strict=True))
    # The first document of a window is the one of the smallest id, null before all others.
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    ids = [rows[k][0] for k in order]
    want = removed_words([texts[k] for k in order], 13, ids)
    got = rlz_dedup.dedup(docs).collect()
    assert count((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == count((i, *w) for i, w in zip(ids, want, strict=True))
    got = ngram_join.near_duplicates(docs).collect()
    parts = brute_components([texts[k] for k in order], 5, 80)
    assert count((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == count((i, n, ids[p]) for i, (n, p) in zip(ids, parts, strict=True))


@pytest.mark.parametrize("least,seed,most", [(60, 16, 2000), (60, 16, 3)])
def test_repeat_groups(corpus, texts_, least, seed, most):
    """Each group is one string with all its occurrences; together the groups cover what is repeated."""
    whole = [(t or "").encode() for t in texts_]
    groups = defaultdict(set)
    for r in suffix_dedup.repeat_groups(corpus, least=least, seed=seed, most=most).collect():
        groups[r["repeat"]].add((r["doc_id"] // 3, r["start"], r["end"]))
    covered = [[False] * len(b) for b in whole]
    for hits in groups.values():
        for d, a, b in hits:
            covered[d][a:b] = [True] * (b - a)
        if len({b - a for _, a, b in hits}) == 1:  # a run of one character is one occurrence, as long as it is
            (text,) = {whole[d][a:b] for d, a, b in hits}
            if len(set(text[:40])) > 3:
                assert hits == {(d, k, k + len(text)) for d, b in enumerate(whole) for k in range(len(b)) if b.startswith(text, k)}
    for b, c, (_, n, _, _) in zip(whole, covered, removed_bytes(whole, least), strict=True):
        assert sum(c) == n, b[:40]
    assert len(groups) > 20


def test_maximal_repeats_against_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(80):
        rows = list({("".join(rng.choice("ab") for _ in range(rng.randint(0, 6))).encode(), b"s" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 6))).encode()) for _ in range(rng.randint(2, 12))})
        if len(rows) < 2:
            continue
        common = suffix_dedup.common_prefix
        want = set()
        for a in rows:
            for b in rows:
                if a < b:
                    left, right = common(a[0], b[0]), common(a[1], b[1])
                    if left + right >= 5:
                        want.add((left, right, tuple(k for k, r in enumerate(rows) if common(r[0], a[0]) >= left and common(r[1], a[1]) >= right)))
        got = {(x, y, tuple(sorted(m.tolist()))) for x, y, m in suffix_dedup.maximal_repeats([r[0] for r in rows], [r[1] for r in rows], 5)}
        assert got == want


def test_texts_longer_than_a_block(spark):
    """Texts beyond the size of a kernel's block, with a passage that repeats across them."""
    import random

    rng = random.Random(2)
    words = [f"w{k}" for k in range(90000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(80)
    texts = [text(100000) + " " + passage, passage + " " + text(95000), text(40), text(90000)]
    assert len(texts[0]) > 1 << 19
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    got = {r["doc_id"]: r for r in rlz_dedup.dedup(docs).collect()}
    for i, w in enumerate(t.split() for t in texts):
        gone = set()
        for k in range(len(w) - 12):
            if first.setdefault(tuple(w[k : k + 13]), i) < i:
                gone.update(range(k, k + 13))
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), len(gone))
    assert all(len(passage) <= r["n_removed"] <= len(passage) + 2 for r in suffix_dedup.dedup(docs).where("doc_id < 2").collect())


def test_factors():
    found = [{"start": 2, "end": 15, "ref": 1}, {"start": 2, "end": 20, "ref": 4}, {"start": 30, "end": 60, "ref": 2}]
    assert rlz_dedup.factor(found, 50) == [(2, 18, 4), (30, 20, 2)]
    assert rlz_dedup.factor([], 9) == []
    found = [{"start": 0, "end": 13, "ref": 1}, {"start": 5, "end": 18, "ref": 3}]
    assert rlz_dedup.factor(found, 40) == [(0, 13, 1), (13, 5, 3)]


def test_empty_tables(nothing):
    for f in (suffix_dedup.dedup, suffix_dedup.repeat_groups, rlz_dedup.dedup, ngram_join.near_duplicates, ngram_join.first_of_each):
        assert f(nothing).collect() == []


def test_null_ids_and_repeated_rows(odd):
    assert suffix_dedup.dedup(odd).count() == rlz_dedup.dedup(odd).count() == odd.count()
    got = {r["doc_id"]: r["n_removed"] for r in rlz_dedup.dedup(odd).where("n_words > 1").collect()}
    assert got == {None: 0, 1: 60, 4: 60}
    assert {r["component_id"] for r in ngram_join.near_duplicates(odd).where("n_shingles > 40").collect()} == {None}
