"""WARC, toxicity, chat, sharding, vectors, components and the pipeline, odd rows included."""

import base64
import collections
import hashlib

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

import corpus_pipeline
from notelattice.llm.chat import escape, format_turn, formatted_digests, parse_turns, prefix_tree, unescape
from notelattice.llm.components import connected_components
from notelattice.llm.ngram_join import jaccard_classes
from notelattice.llm.packing import pack
from notelattice.llm.quality import quality_rules
from notelattice.llm.queries import tokenizer_path
from notelattice.llm.scratch import scratch_path
from notelattice.llm.sharding import ShardedTable, compacted, sharded_digests
from notelattice.llm.toxicity import fit_ordinal, toxicity
from notelattice.llm.vectors import near_duplicate_vectors, plan
from notelattice.llm.warc import arc_archives, convert_arc, page_records, parse_arc


def test_warc_round_trip(spark, sf_dir):
    given = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    odd = [(10**6, None, None), (10**6 + 1, "http://a b/é\n", ""), (10**6 + 2, "x", "\r\n\r\nWARC/1.1\r\n\r\nq"), (10**6 + 3, "y", "\r\n\r\nWARC/1.1\r\n\r\nq"), (10**6 + 3, "y", "\r\n\r\nWARC/1.1\r\n\r\nq"), (10**6 + 4, "z", "é" * 60000)]
    rows = given + odd
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    for least in (0, 5):
        first: dict = {}
        for i, _, h in rows:
            body = (h or "").encode()
            if len(body) >= least:
                first[body] = min(first.get(body, i), i)
        want = collections.Counter()
        for i, _, h in rows:
            body = (h or "").encode()
            origin = first.get(body, i)
            want[i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if origin == i else "revisit", None if origin == i else origin] += 1
        assert collections.Counter(tuple(r) for r in page_records(df, scratch_path(spark, "warc"), least).collect()) == want
    assert page_records(df.limit(0), scratch_path(spark, "warc")).count() == 0


def test_arc_versions_and_damage(spark):
    one = b"filedesc://a 0.0.0.0 20240101 text/plain 75\n1 0 x\nURL IP-address Archive-date Content-type Archive-length\n\n" b"http://h/a b 1.2.3.4 20240102030405 text/html 5\nhello\nhttp://h/c 1.2.3.4 20240102 text/html 99\ncut"
    at = one.index(b"\n") + 1
    one = one.replace(b" 75\n", f" {one.index(b'http://h/a') - at}\n".encode(), 1)
    got = [(f["URL"], b, cut) for f, b, cut in parse_arc(one)]
    assert got == [("http://h/a b", b"hello", False), ("http://h/c", b"cut", True)]
    df = spark.createDataFrame([(bytearray(one),), (bytearray(b"junk"),), (bytearray(b""),)], "content binary")
    rows = {r.uri: r for r in convert_arc(df).collect()}
    assert rows["http://h/a b"].date == "2024-01-02T03:04:05Z" and rows["http://h/c"].truncated and rows["http://h/c"].date == "2024-01-02T00:00:00Z"
    pages = spark.createDataFrame([(k, f"http://h/{k}", "x" * 3_000_000) for k in range(4)], "page_id long, url string, html string").coalesce(1)
    versions = {bytes(r.content).split(b"\n")[1][:1] for r in arc_archives(pages).collect()}
    assert versions == {b"1", b"2"}


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 4, 600)
    rows, feats = zip(*[(k, f) for k, g in enumerate(grade) for f in range(g)])
    w, theta = fit_ordinal(np.array(rows), np.array(feats), grade, 5)
    assert (np.diff(theta) > 0).all() and (w[:3] > 0).all()
    z = np.bincount(rows, w[list(feats)], len(grade))
    up = 1 / (1 + np.exp(-(z[:, None] - theta)))
    assert np.abs(up.sum(1) - grade).mean() < 0.2


def test_toxicity_on_held_out_rows(spark, sf_dir):
    d, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/{n}.parquet") for n in ("documents", "labels"))
    got = toxicity(d, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").toPandas()
    assert got[got.toxic == 0].rejected.mean() < 0.005 and got[got.toxic == 1].rejected.mean() > 0.5
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "fine words", "x"), (1, "idiot " * 20000, "x")], "doc_id long, text string, severity string")
    clean = toxicity(odd, labels.limit(0)).collect()
    assert len(clean) == 4 and not any(r.rejected for r in clean)
    mixed = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (99, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert toxicity(odd, mixed).count() == 4 and toxicity(odd.limit(0), mixed).count() == 0


def test_chat_round_trip(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said), (901, 0, "us<er", "\\l<|end|>[\\"), (901, 1, None, None), (901, 1, "assistant", None), (902, 0, "assistant", "é\U0001f600<|turn|>x<|says|>"), (None, None, None, None)]
    rows += [(2000 + k, t, "user" if t % 2 == 0 else "assistant", f"shared {t}" if t < 3 else f"own {k % 4}") for k in range(20) for t in range(5)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int")
    convs = collections.defaultdict(list)
    for i, k, r, x in rows:
        convs[i].append((-1 if k is None else k, r or "", x or ""))
    want = {}
    for i, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        want[i] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len(format_turn(r, x)) for _, r, x in turns))
    assert {r.conv_id: tuple(r)[1:] for r in formatted_digests(df).collect()} == want
    stream, _ = prefix_tree(df)
    nodes = stream.orderBy("begin").collect()
    at = 0
    spans = {}
    for r in nodes:  # depth first: every ancestor comes before and covers what lies above
        assert r.begin == at and r.length == len(r.text)
        at += r.length
        spans[r.begin] = r.begin + r.length
        assert all(spans[a.begin] == a.end for a in r.ancestors) and r.position == sum(a.end - a.begin for a in r.ancestors)
    shared = [r for r in nodes if "shared 0" in r.text]
    assert len(shared) == 1 and shared[0].turns == 3
    assert sum("own 1" in r.text for r in nodes) == 1
    assert formatted_digests(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<[\\l\\b", "<|turn|>", "[INST]", "a\\\\<b"])
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text and "<" not in escape(text) and "[" not in escape(text)
    assert parse_turns(format_turn(text, text) * 2) == [(text, text)] * 2


def test_sharding(spark, sf_dir, tmp_path):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("tier", F.lit("clash")).withColumn("path", F.lit(1))
    d = d.union(d.limit(3)).union(spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in d.schema]))
    table = compacted(d, f"file://{tmp_path}/t", arrivals=6, target=150 << 10)
    assert table.read().select(*d.columns).exceptAll(d).isEmpty() and d.exceptAll(table.read().select(*d.columns)).isEmpty()
    m, sixth = table.manifest().collect(), table.manifest(6).count()
    first = table.manifest(1).count()
    assert table.read(6).count() == d.count() and 0 < table.read(1).count() < d.count()  # older versions stay
    table.expire(keep=2)
    assert table.read(table.version() - 1).count() == table.read().count() == d.count()
    table.expire()
    with pytest.raises(AnalysisException):
        table.read(1).count()
    with pytest.raises(ValueError):
        table.append(d.withColumn("__shard_path", F.lit(1)))
    assert table.version() >= 7 and first < sixth and len(m) < sixth
    assert sum(r.rows for r in m) == d.count()
    with pytest.raises(RuntimeError):
        table._commit(table.manifest(), table.version())
    none = ShardedTable(spark, f"file://{tmp_path}/none")
    assert none.append(d.limit(0)) == 0 and none.compact() == 0 and none.manifest().count() == 0
    assert sharded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).count() == 200
    assert sharded_digests(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)).count() == 0


def brute_vectors(rows, threshold):
    keep = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {i: (0, i) for i, _ in rows}
    unit = np.array([v / np.linalg.norm(v) for _, v in keep])
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    ids = np.array([i for i, _ in keep])
    label = ids.copy()
    while True:
        new = np.array([min([label[k], *label[near[k]]]) for k in range(len(ids))])
        if (new == label).all():
            break
        label = new
    return out | {int(i): (int(n), int(c)) for i, n, c in zip(ids, near.sum(1), label)}


def test_vectors(spark, sf_dir, monkeypatch):
    import notelattice.llm.vectors as v

    rng = np.random.default_rng(0)
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    base = rng.standard_normal(64)
    rows += [(10000 + k, [float(x) for x in base + 0.1 * rng.standard_normal(64)]) for k in range(120)]
    rows += [(20000 + k, [float(x) for x in base]) for k in range(30)]
    rows += [(30000, None), (30001, [0.0] * 64), (30002, [float("nan")] * 64), (30003, [None] * 64), (30004, []), (30005, [float("inf")] + [1.0] * 63)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, cell int")
    want = brute_vectors(rows, 0.9)
    monkeypatch.setattr(v, "BLOCK", 50)  # so that hot cells are cut into blocks
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(df, 0.9).collect()}
    assert got.keys() == want.keys() and all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)
    assert near_duplicate_vectors(df.limit(0)).count() == 0
    assert all(plan(n, 0.9)[0] <= plan(10 * n, 0.9)[0] for n in (10, 1000, 10**6))


def test_components(spark):
    links = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (100, 100), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links + [(None, 5), (6, None)], "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {100: 100, 101: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages_take_effect(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs, kept = d, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == d.columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    bad = {r.doc_id for r in toxicity(d, labels).where("rejected").collect()}
    every = {r.doc_id for r in d.select("doc_id").collect()}
    assert kept[0] == every - bad
    second = d.where(F.col("doc_id").isin(*kept[0]))
    assert kept[1] == {r.doc_id for r in quality_rules(second).where("kept").collect()}
    third = d.where(F.col("doc_id").isin(*kept[1]))
    assert kept[2] == {r.doc_id for r in jaccard_classes(third, 5, 80).where("doc_id = component_id").collect()}
    last = d.where(F.col("doc_id").isin(*kept[2]))
    want = pack(last, tokenizer_path("word_bpe_49k.json"))
    order = ["doc_id", "start"]
    assert corpus_pipeline.run(spark, sf_dir).orderBy(*order).collect() == want.orderBy(*order).collect()
    assert corpus_pipeline.ngram_jaccard_join(spark, spark.createDataFrame([(None, "a b c d e f", None, None, 1)], d.schema), sf_dir).count() == 1
