"""Ranked search, removal of repeated windows and spelling groups against plain Python, odd rows included."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from notelattice.llm import lexical, repeats, spelling
from notelattice.llm.lexical import lexical_search
from notelattice.llm.repeats import removal_digests, remove_repeats
from notelattice.llm.spelling import crc32_spans, spelling_groups, spelling_variants

ODD = [None, "", " \n\t ", "one", "Ünder ünder UNDER x", "A.B-c d\x00e   naïve_naïve × ÷ café́", "word " * 300, "x" * 30000, "the\ncat sat", "é" * 9 + " " + "é" * 8]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    odd = [(10**6 + k, t) for k, t in enumerate(ODD)]
    return given + odd + [given[3], given[3], (given[5][0], given[6][1]), (None, given[7][1]), (None, given[7][1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # columns whose names clash with those that operators use inside
    rows = [(*t, 1, "r", 2.0, "w") for t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, block int, rank string, n double, word string").repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def searched(rows, items, k):
    sets = [(i, collections.Counter(terms(t))) for i, t in rows]
    sets = [(i, c, sum(c.values())) for i, c in sets if c]
    big_n, big_l = len(sets), sum(n for *_, n in sets)
    df = collections.Counter(t for _, c, _ in sets for t in c)
    out = []
    for item, parts in items.items():
        want = collections.Counter(t for p in parts for t in terms(p))
        scores = []
        for i, c, n in sets:
            m = 25 + 75 * n * big_n // big_l
            s = sum(times * math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in want.items() if c[t])
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [8 << 20, 200])
def test_search_equals_plain_python(spark, sf_dir, docs, texts, empty, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block_bytes)  # 200: an automaton for each few items
    given = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()][: 40 if block_bytes > 200 else 6]
    rows = [*given, (900, None), (901, ""), (902, "ünder CAFÉ é"), (903, "... !"), (None, given[0][1]), given[1], (given[2][0], "another the text"), (904, "zz" * 50)]
    items = collections.defaultdict(list)
    for i, t in rows:
        items[i].append(t)
    got = lexical_search(docs, spark.createDataFrame([(*r, 1) for r in rows], "item_id long, text string, score int"), k=7)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == searched(texts, items, 7)
    table = spark.createDataFrame(given[:2], "item_id long, text string")
    assert lexical_search(empty, table).count() == 0 and lexical_search(docs, table.limit(0)).count() == 0
    assert lexical_search(docs.where("text IS NULL"), table).count() == 0


def cut(rows, window):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    first = collections.defaultdict(lambda: (float("inf"),))
    for i, w in words:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            first[k] = min(first[k], (float("inf") if i is None else i,))
    out = []
    for i, w in words:
        gone, seen = set(), set()
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            if first[k][0] < (float("inf") if i is None else i) or k in seen:
                gone |= set(range(s, s + window))
            seen.add(k)
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [3, 20])
def test_repeats_equal_plain_python(docs, texts, empty, window, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 20_000)  # several blocks in a partition
    got = removal_digests(docs, window)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == cut(texts, window)
    assert removal_digests(empty).count() == 0


def test_intervals_are_maximal_and_numbers_of_groups_do_not_matter(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(1, f"a b {passage} c"), (2, f"{passage} d e {passage}"), (3, f"x {' '.join(f'p{k}' for k in range(30))} y"), (0, "q " * 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for groups in (1, 7, 70_000):
        got = {r.doc_id: ([(x.start, x.end) for x in r.removed], r.kept_text) for r in remove_repeats(df, 20, groups).collect()}
        assert got == {1: ([], rows[0][1]), 2: ([(0, 40), (42, 82)], "d e"), 3: ([(1, 31)], "x y"), 0: ([(1, 600)], "q")}


def counted(rows):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def grouped(n, ratio=10):
    close = collections.defaultdict(set)
    holes = collections.defaultdict(set)  # words by what they are without one letter, or with any in its place
    for w in n:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
            holes["gone", w[:k] + w[k + 1 :]].add(w)
        holes["gone", w].add(w)
    for some in holes.values():
        for u in some:
            close[u] |= {v for v in some if v != u and near(u, v)}
    form = {}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n)


def test_spelling_equals_plain_python(docs, texts, empty):
    got = spelling_variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = grouped(counted(texts))
    assert sum(r[1] is not None for r in want) > 5
    assert sorted(map(tuple, got.collect())) == want
    assert spelling_variants(empty).count() == 0


def test_spelling_of_large_buckets_chains_and_ties(spark, monkeypatch):
    rng = np.random.default_rng(4)
    words = {"".join(rng.choice(list("abé"), rng.integers(7, 11))): int(10 ** rng.integers(0, 5)) * int(rng.integers(1, 3)) for _ in range(1500)}
    words |= {"k" * 7: 1, "k" * 8: 10, "k" * 9: 100, "k" * 10: 1000, "\U0001f600" * 7: 3, "\U0001f600" * 8: 30, "y" * 5000: 1, "y" * 2500 + "z" + "y" * 2500: 10}
    want = grouped(words)
    assert max(r[4] for r in want) > 5
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(map(tuple, spelling_groups(df).collect())) == want
    monkeypatch.setattr(spelling, "BUCKET", 6)  # buckets are cut into blocks
    assert sorted(map(tuple, spelling_groups(df).collect())) == want


def test_crc32_of_spans_equals_zlib():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000).astype(np.uint8)
    starts = rng.integers(0, 2700, 200)
    ends = starts + rng.integers(0, 300, 200)
    seeds = np.array([zlib.crc32(bytes([k])) for k in range(200)], np.uint32)
    assert crc32_spans(data, starts, ends, seeds).tolist() == [zlib.crc32(data[a:b].tobytes(), int(s)) for a, b, s in zip(starts, ends, seeds)]


def test_rows_without_an_id(spark):
    """Every operator gives such rows a result of their own."""
    from notelattice.llm.bpe import encoded_digests
    from notelattice.llm.packing import pack
    from notelattice.llm.quality import quality_rules
    from notelattice.llm.queries import tokenizer_path
    from notelattice.llm.token_files import token_file_round_trip
    from notelattice.llm.vectors import near_duplicate_vectors

    rows = [(None, "one two three"), (1, "one two three"), (None, None), (2, "four")]
    df = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")
    word, byte = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")
    tokens = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in encoded_digests(df, word).collect()}
    assert len(tokens) == 4 and {(n, h) for i, n, h in tokens if i == 1} <= {(n, h) for i, n, h in tokens if i is None}
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_words) for r in quality_rules(df).collect()) == [(False, 1, 3), (False, 2, 1), (True, 0, 0), (True, 0, 3)]
    packed = pack(df, word, end_id=2, length=4096).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in packed) == [(False, 1, 4), (False, 2, 2), (True, 0, 1), (True, 0, 4)]
    files = token_file_round_trip(df, byte, end_id=0).collect()
    assert len(files) == 4 and sum(r.doc_id is None for r in files) == 2 and sorted(r.start for r in files)[0] == 0
    v = spark.createDataFrame([(None, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0]), (None, None)], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links) for r in near_duplicate_vectors(v).collect())
    assert got == [(False, 3, 1), (False, 4, 0), (True, 0, 0), (True, 0, 1)]
