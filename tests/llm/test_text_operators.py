"""N-gram join, BPE, quality rules, packing and token files against plain Python, odd rows included."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from notelattice.llm import bpe, quality
from notelattice.llm.bpe import encoded_digests, encoded_documents
from notelattice.llm.ngram_join import jaccard_classes
from notelattice.llm.packing import curve_keys, hilbert_key, pack
from notelattice.llm.quality import js_distance, kept_rows, quality_rules
from notelattice.llm.queries import tokenizer_path
from notelattice.llm.textcols import span_hashes
from notelattice.llm.token_files import decode_chunks, encode_chunk, pack_words, token_file_round_trip, unpack_words

ODD = [
    None, "", "  \n\t ", "one", "two words", "Two  WORDS", "a<|endoftext|>B   \nq", "<|ENDOFTEXT|> A.B. 12.5, 3.", "İSTANBUL ΣΑΣ. Σ. x's. don'T, é. \x1c a \x85b",
    "x\xa0 y 　 z \n\nw  \t ", "ﬁ ① K.,", "a ́b", "\U0001f600\U0001f600. ok,", "word " * 3000, "x" * 30000,
]


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    given = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    odd = [(10**6 + k, t, "en" if k % 2 else None) for k, t in enumerate(ODD)]
    return given + odd + [given[3], given[3]]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark, texts):
    # columns whose names clash with those that operators use inside
    rows = [(*r, "s", 1, 2.0) for r in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, part string, token int, component double")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def classes(rows, n, percent):
    sets = {i: shingles(t, n) for i, t, *_ in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x = len(sets[a] & sets[b])
            if x and 100 * x >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_classes(docs, texts, empty, n, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(docs, n, percent).collect()}
    assert got == classes(texts, n, percent)
    assert jaccard_classes(empty, n, percent).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 88, 90, 95, 100])
def test_similar_sets_share_a_bucket(percent):
    from notelattice.llm.ngram_join import _class_edges, bucket_keys

    rng, found = np.random.default_rng(percent), 0
    edges = _class_edges(percent, 1000)
    for _ in range(2000):
        x = np.unique(rng.integers(0, 2**64, int(rng.integers(1, 400)), dtype=np.uint64))
        d = int(rng.integers(0, max(1, int(len(x) * (100 - percent) / 80)) + 1))
        gone = rng.permutation(len(x))[: int(rng.integers(0, d + 1))]
        y = np.unique(np.concatenate([np.delete(x, gone), rng.integers(0, 2**64, d - min(d, len(gone)), dtype=np.uint64)]))
        both = len(np.intersect1d(x, y))
        if len(y) and 100 * both >= percent * (len(x) + len(y) - both) and not len(x) == len(y) == both:
            found += 1
            keys = [bucket_keys(z, z[: len(z) - -(-percent * len(z) // 100) + 1], percent, edges) for z in (x, y)]
            assert len(np.intersect1d(*keys))
    assert found > 100 or percent == 100


def test_jaccard_of_null_ids_and_shared_passages(spark, monkeypatch):
    import notelattice.llm.ngram_join as join

    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{passage} " + " ".join(f"q{k}x{j}" for j in range(60))) for k in range(40)]  # share a passage, aren't similar
    rows += [(None, rows[3][1]), (None, "only here a b c"), (None, None), (90, rows[3][1].replace("q3x59", "q3y59"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for n, percent in ((3, 90), (5, 80)):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in join.jaccard_classes(df, n, percent).select("doc_id", "component_id").collect() if r.component_id is not None)
        assert got == sorted([*((False, k, k) for k in range(40)), (False, 90, 3), (True, 0, 3)])


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_links_of_ids_whose_hashes_have_equal_sums(spark, n, percent):
    """xxhash64 of the first two ids and of the last two add up to the same number modulo 2^40."""
    one, two = [f"a{k}" for k in range(150)], [f"b{k}" for k in range(150)]
    rows = [(2037270, " ".join(one)), (2037271, " ".join([*one, "z"])), (5917502, " ".join(two)), (5917503, " ".join([*two, "z"]))]
    got = {r.doc_id: r.component_id for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
    assert got == {2037270: 2037270, 2037271: 2037270, 5917502: 5917502, 5917503: 5917502}


def test_jaccard_join_of_a_large_group_and_of_chains(spark, monkeypatch):
    import notelattice.llm.ngram_join as join

    monkeypatch.setattr(join, "BLOCK", 40)  # so that buckets are cut into blocks
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(150):  # near copies at several distances, some linked only through others
        w = list(base)
        for p in rng.choice(120, rng.integers(0, 5), replace=False):
            w[p] = f"x{rng.integers(0, 40)}"
        rows.append((k, " ".join(w)))
    other = [f"v{k}" for k in range(120)]
    rows += [(1000 + k, " ".join(other[k // 2 :] + [f"y{k}"] * (k // 2))) for k in range(30)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == classes(rows, 3, 90)


def test_bpe_equals_the_library(docs, texts, empty, monkeypatch):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    want = collections.Counter()
    for i, text, _ in texts:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(tuple(r) for r in encoded_digests(docs, path).collect()) == want
    assert encoded_digests(empty, path).count() == 0
    monkeypatch.setattr(bpe, "GROUP_BYTES", 20)  # many groups of words and a block for each document give the same
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 1)
    assert collections.Counter(tuple(r) for r in encoded_digests(docs, path).collect()) == want
    row = encoded_documents(docs.where("doc_id = 3"), path).first()
    text = next(t for i, t, _ in texts if i == 3)
    assert np.frombuffer(row.ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_quality_base_counts(docs, texts, empty):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    want = collections.Counter()
    for i, text, _ in texts:
        text = text or ""
        w = word.findall(text)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        seen, covered = collections.Counter(grams), set()
        for k, g in enumerate(grams):
            covered |= {k, k + 1, k + 2} if seen[g] > 1 else set()
        lines = [x for x in text.split("\n") if word.search(x)]
        want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    got = quality_rules(docs).collect()
    assert collections.Counter(tuple(r)[1:7] and tuple(r)[:7] for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality_rules(empty).count() == 0
    assert kept_rows(docs).columns == docs.columns and kept_rows(docs).count() == sum(r.kept for r in got)


def test_quality_keeps_prose_and_drops_junk(spark, sf_dir):
    d, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality_rules(d).join(labels, "doc_id").where("NOT base_failed").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert good.kept.mean() > 0.99 and bad.kept.mean() < 0.5


def test_quality_of_null_and_rare_languages(spark, sf_dir):
    d, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{n}.parquet").toPandas() for n in ("documents", "labels"))
    clean = d[d.doc_id.isin(labels[labels.quality == 1].doc_id) & (d.lang == "en") & (d.text.str.split().str.len() >= 60)].doc_id.tolist()
    kept = {}
    for n in (10, 29, 31, 60):
        for name in (None, "xx"):
            d["lang2"] = d.lang.where(~d.doc_id.isin(clean[:n]), name)
            rows = [(int(i), t, x if isinstance(x, str) else None) for i, t, x in zip(d.doc_id, d.text, d.lang2)]
            got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("NOT base_failed").collect()
            if name is None or n < 30:
                kept[n, name] = {r.doc_id for r in got if r.kept} & set(clean[:n]), {r.doc_id for r in got} & set(clean[:n])
    assert all(len(a) >= 0.95 * len(b) for a, b in kept.values()), {k: (len(a), len(b)) for k, (a, b) in kept.items()}
    assert kept[29, None][0] == kept[31, None][0] & set(clean[:29])


def plain_quality(rows):
    """(char distance, word distance, kept) of each row, one by one."""
    whole = lambda data: int(span_hashes(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]), lower=True).view(np.int64)[0])
    hashed, parsed, use = {}, [], {}
    for _, text, lang in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        keys = [w[:-1].lower() if len(w) > 1 and w[-1:] in b".,;:?!" else w.lower() for w in words]
        chars = np.zeros(8)
        for c in text or "":
            chars[0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\x0b\x0c" else 4 if c in "\n\r" else 5 if c in ".,;:?!'\"()-" else 7 if ord(c) > 127 else 6] += 1
        parsed.append((words, keys, chars / max(chars.sum(), 1)))
        for name in {lang, "all"} if lang else {"all"}:
            for k in set(keys):
                hashed.setdefault(k, whole(k))
                use.setdefault(name, {}).setdefault(k, 0)
                use[name][k] += 1
    sizes = {}
    for _, text, lang in rows:
        if lang and text:
            sizes[lang] = sizes.get(lang, 0) + 1
    home = [x if x and sizes.get(x, 0) >= 30 else "all" for *_, x in rows]
    common = {name: {k: i for i, k in enumerate(sorted(n, key=lambda k: (-n[k], hashed[k]))[:64])} for name, n in use.items()}

    def bins(keys, name):
        out = np.zeros(65)
        for k in keys:
            out[common[name].get(k, 64)] += 1
        return out / max(out.sum(), 1)

    def distance(p, q):
        m = (p + q) / 2
        d = sum(x * np.log2(x / y) for x, y in zip(p, m) if x) + sum(x * np.log2(x / y) for x, y in zip(q, m) if x)
        return float(np.sqrt(max(d, 0) / 2)) if p.sum() else 0.0

    mean = {}
    for name in {*home, "all"}:
        mine = [p for p, h in zip(parsed, home) if (name == "all" or h == name) and p[0]]
        mean[name] = np.mean([p[2] for p in mine], 0), np.mean([bins(p[1], name) for p in mine], 0)
    out = {}
    for (doc, _, _), (words, keys, chars), name in zip(rows, parsed, home):
        dc, dw = distance(chars, mean[name][0]), distance(bins(keys, name), mean[name][1])
        far = dc > 0.28 and sum(len(w.decode()) for w in words) >= 100 or dc + dw > 0.56 and len(words) >= 60
        out[doc] = dc, dw, far
    return out


@pytest.mark.parametrize("most", [2, 255])
def test_quality_verdicts_equal_plain_python_however_many_languages(spark, sf_dir, monkeypatch, most):
    monkeypatch.setattr(quality, "MAX_LANGS", most)
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text, (None, "a", "b", "c", "d", "rare")[min(r.doc_id % 5, 5) if r.doc_id % 17 else 5]) for r in texts]
    rows += [(-1, "# $ % " * 60, "a"), (-2, None, "b"), (-3, "", None), (-4, "ZEBRA 12 " * 80, "c"), (-5, "é à ü " * 50, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in quality_rules(docs).collect()}
    want = plain_quality(rows)
    assert got.keys() == want.keys() and len({x for *_, x in rows}) == 6
    for k, (dc, dw, far) in want.items():
        assert abs(got[k].char_distance - dc) < 1e-5 and abs(got[k].word_distance - dw) < 1e-5, (k, dc, dw, got[k])
        assert got[k].kept == (not got[k].base_failed and not far)
    assert sorted(r.doc_id for r in kept_rows(docs).select("doc_id").collect()) == sorted(k for k, r in got.items() if r.kept)


def test_js_distance_bounds():
    p, q = np.array([[1.0, 0], [0.5, 0.5], [0, 0]]), np.array([[0, 1.0], [0.5, 0.5], [1.0, 0]])
    assert np.allclose(js_distance(p, q), [1, 0, 0])


def test_hilbert_key_visits_neighbours():
    for bits in (1, 2, 4):
        x = np.stack(np.meshgrid(*[np.arange(1 << bits)] * 3, indexing="ij"), -1).reshape(-1, 3)
        key = hilbert_key(x, bits)
        assert sorted(key) == list(range(len(x)))
        assert (np.abs(np.diff(x[np.argsort(key)], axis=0)).sum(1) == 1).all()
    assert len(curve_keys(np.zeros(0, np.uint32), np.zeros(1, np.int64))) == 0


def test_packing_places_each_id_once(docs, texts, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = {i: t.encode(text or "", add_special_tokens=False).ids + [2] for i, text, _ in texts}
    times = collections.Counter(i for i, *_ in texts)
    got = pack(docs, path, length=512).collect()
    seqs, whole = collections.defaultdict(list), collections.Counter()
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(piece, "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        seqs[r.sequence_id].append(r)
        whole[r.doc_id] += r.length
    assert whole == {i: times[i] * len(v) for i, v in ids.items()}
    for k, pieces in seqs.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 512 or k == max(seqs)
    assert sorted(seqs) == list(range(len(seqs)))
    assert pack(empty, path).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 59, 60, 1023, 1024, 1025, 5000):
        for high in (1, 2, 300, 4096, 1 << 31):
            codes = rng.integers(0, high, n).astype(np.uint64)
            codes[rng.random(n) < 0.5] = 0
            words, offsets = pack_words(codes)
            assert (unpack_words(words, offsets, n) == codes).all()
    ids = rng.integers(0, 50257, 20000).astype("<u4")  # more ids than the table holds: escapes
    raw = encode_chunk(3, 1, [7, None], [12000, 8000], ids) + b"\n.s8b\n"
    ((part, number, docs_, lengths, back),) = decode_chunks(raw)
    assert (part, number, docs_, lengths.tolist()) == (3, 1, [7, None], [12000, 8000]) and (back == ids).all()
    with pytest.raises(ValueError):
        list(decode_chunks(raw[:-3]))


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
def test_ids_of_a_column_equal_the_library(name, kind):
    from tokenizers import Tokenizer

    from notelattice.llm.tokens import ChunkTable

    rng = np.random.default_rng(5)
    parts = ["a", "B", "word", "Ünï", "don't", "x.", "!!", "12", " ", "  ", "\n", "\t\n", "\r", "\x0b", "\u3000", "\xa0", "\u2009", "\x1c", "<|endoftext|>", "<|X", "日本", "é,"]
    texts = ["".join(parts[k] for k in rng.integers(0, len(parts), rng.integers(0, 12))) for _ in range(3000)] + [None, "", " ", "a", " a ", "\u3000 \n b"]
    t, table = Tokenizer.from_file(tokenizer_path(name)), ChunkTable(tokenizer_path(name), kind)
    for some in (texts, texts[:1], texts[-6:], ["", None], []):
        flat, begin = table.column_ids(pa.array(some, pa.string()))
        assert [flat[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == [t.encode(x or "", add_special_tokens=False).ids for x in some]


def test_token_files_equal_the_library(docs, texts, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want, at = [], 0
    for i, text in sorted(((i, x or "") for i, x, _ in texts), key=lambda r: r[0]):
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in token_file_round_trip(docs, path).collect()) == sorted(want)
    assert token_file_round_trip(empty, path).count() == 0
