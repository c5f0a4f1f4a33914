"""Literal cases, readers, streams and brute-force comparisons of operators that SQL does not check."""

import datetime
import json
import math
import random
import re
import weakref
import zlib
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import GroupedData, functions as F

from notelattice.functions.rules import CASELESS, HASH_TYPES, NAME_STOPWORDS, PATTERNS, STARTS, TTL_DAYS
from notelattice.operators import evaluate, evolve, extract, fusion, graph, index, notes, ontology, retrieve, rules
from notelattice.operators.evolve import ShiftState
from notelattice.plans import QUERIES, derived
from notelattice.plans.derived import Tables
from notelattice.plans.notes import entity_index
from notelattice.sources import tables
from notelattice.sources.bundles import read_objects
from notelattice.streaming import jobs


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_extraction_reproduces_spellings_and_drops_code_hashes(spark):
    md5, sha = "d41d8cd98f00b204e9800998ecf8427e", "a" * 40
    text = f"APT 28 and APT-28, not 256.1.1.1 but 10.0.0.1.\ncommit {sha}\nseen {md5}\nAna: went to New York\nNote: x"
    df = spark.createDataFrame([("n", text), ("e", ""), ("z", None)], "note_id string, content_raw string")
    got = {(r.entity_type, r.entity_value) for r in extract.extract_all_long(df).collect()}
    assert {("intrusion_set", "apt-28"), ("ipv4", "10.0.0.1"), ("md5", md5), ("person", "ana"), ("location", "new-york")} <= got
    assert ("sha1", sha) not in got and ("person", "note") not in got and ("ipv4", "256.1.1.1") not in got


def test_keywords_break_ties_by_first_appearance(spark):
    df = spark.createDataFrame([("n", "zeta alpha zeta alpha beta with this naïve"), ("e", "")], "note_id string, content_raw string")
    assert [r.keyword for r in notes.keywords_topk(df).orderBy("rank").collect()] == ["zeta", "alpha", "beta"]
    assert df.where("note_id = 'n'").select(notes.keyword_array(F.col("content_raw"))).first()[0] == ["zeta", "alpha", "beta"]


def test_chunks_cover_the_text_and_keep_to_the_size(spark):
    text = ". ".join(f"sentence number {k} of the report" for k in range(200))
    df = spark.createDataFrame([("r", text), ("s", "short"), ("e", "")], "source_ref string, content_raw string")
    got = notes.chunk_report(df, 500).collect()
    long = [r.chunk for r in got if r.source_ref == "r"]
    assert ". ".join(long) == text and max(map(len, long)) <= 500
    over = [r.chunk for r in notes.chunk_sentences(df.withColumn("content_raw", F.regexp_replace("content_raw", r"\. ", ".  ")), "source_ref", "content_raw", 300, 50, 20).collect() if r.source_ref == "r"]
    assert all(b.startswith(a[-50:]) for a, b in zip(over, over[1:]))


def test_pii_spans_resolve_overlaps(spark):
    df = spark.createDataFrame([(1, "mail ops@evil.com or (555) 123-4567, host 10.0.0.1"), (2, ""), (3, None)], "id int, text string")
    got = rows(notes.pii_detect(df, "id", "text"))
    assert [(r[1], r[4].strip()) for r in got] == [("EMAIL_ADDRESS", "ops@evil.com"), ("PHONE_NUMBER", "(555) 123-4567")]
    every = {(r[1]) for r in rows(notes.pii_detect(df, "id", "text", False))}
    assert every == {"EMAIL_ADDRESS", "PHONE_NUMBER", "IP_ADDRESS"}  # the domain lies inside the address


def test_vector_topk_equals_brute_force(spark):
    data = [(str(k), [math.sin(k * j + j) for j in range(1, 9)]) for k in range(60)] + [("zero", [0.0] * 8), ("none", None)]
    df = spark.createDataFrame(data, "id string, v array<double>")
    got = {(r.query_id, r.rank): r.note_id for r in retrieve.vector_topk(df.where("id IN ('3', '4')"), df, 5, None).collect()}

    def cos(a, b):
        n = math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / n, 9) if n else 0.0

    for q in ("3", "4"):
        best = sorted((-cos(dict(data)[q], v), k) for k, v in data if v)[:5]
        assert [got[q, r] for r in range(1, 6)] == [k for _, k in best]


def test_cosines_of_every_query_with_every_vector(spark, sf_dir):
    from notelattice.plans import QUERIES

    v = {r.vec_id: [float(x) for x in r.embedding] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    norm = {k: math.sqrt(sum(x * x for x in a)) for k, a in v.items()}
    got = {(r.query_id, r.note_id): r.score for r in QUERIES["cosine_similarity_all"](spark, sf_dir).collect()}
    assert set(got) == {(q, n) for q in v if q % 50 == 0 for n in v}
    assert all(abs(s - sum(x * y for x, y in zip(v[q], v[n])) / norm[q] / norm[n]) < 2e-6 for (q, n), s in got.items())
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0])], "id long, v array<double>")
    assert [(a, b, round(s, 9)) for a, b, s in rows(retrieve.cosine_pairs(odd, odd))] == [(1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0), (2, 2, 1.0), (4, 4, 1.0)]


def test_lsh_finds_the_neighbours_of_the_exact_search(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    twins = v.where("vec_id = 0").select(F.explode(F.sequence(F.lit(1001), F.lit(1012))).alias("vec_id"), "embedding")
    v, q = v.union(twins), v.where("vec_id % 50 = 0")  # query 0 has its hits near, the others have none
    want = {(r.query_id, r.note_id) for r in retrieve.vector_topk(q, v, 10, None).collect()}
    got = retrieve.vector_topk_lsh(q, v, 10).collect()
    assert len(got) == len(want) == 10 * q.count()
    assert len(want & {(r.query_id, r.note_id) for r in got}) >= 0.9 * len(want)


@pytest.mark.parametrize("values", [5, 1000])
def test_fusion_of_posting_lists_equals_all_pairs(spark, values):
    rng = random.Random(values)
    scores = {f"n{k:03}": (rng.choice([None, 1, 1]) and rng.randrange(values), rng.choice([None, 1]) and rng.randrange(values)) for k in range(300)}
    lists = [("tool", f"e{e}", n) for e in range(6) for n in scores if rng.random() < (0.9 if e == 0 else 0.1)]
    asked = [(q, "tool", f"e{e}") for q in range(9) for e in rng.sample(range(7), 1 + q % 3)] + [(3, "tool", "nowhere")]
    weights = [(q, *w) for q, w in enumerate([(0.5, 0.5), (1.0, 0.0), (0.0, 1.0), (0.3, 0.7), (0.0, 0.0), (0.9, 0.1), (0.2, 0.2), (0.5, 0.5), (0.1, 0.9)])]
    a = spark.createDataFrame(asked, "query_id int, entity_type string, entity_value string")
    p = spark.createDataFrame([(*x, *scores[x[2]]) for x in lists], "entity_type string, entity_value string, note_id string, vs int, gs int").repartition(6)
    w = spark.createDataFrame(weights, "query_id int, vector double, graph double")
    pairs = a.join(p, ["entity_type", "entity_value"]).select("query_id", "note_id", "vs", "gs").distinct()
    v, g = (pairs.where(f"{c} IS NOT NULL").select("query_id", "note_id", F.col(c).alias("score")) for c in ("vs", "gs"))
    for prune in (False, True):
        assert rows(fusion.blend_weighted_postings(a, p, w, 4, prune)) == rows(retrieve.blend_weighted(v, g, w, 4))
    assert rows(fusion.blend_rrf_postings(a, p, 4)) == rows(retrieve.blend_rrf(v, g, 4))
    band = fusion.skyband(p, 4).count()
    assert band < len(lists) and (values == 1000 or band <= 6 * 4 * 36)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_lsh_compares_few_rows_and_takes_no_exact_pass(spark, folder):
    v = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").select("vec_id", "embedding")
    q, n = v.where("vec_id % 50 = 0"), v.count()
    want = {(r.query_id, r.note_id) for r in retrieve.vector_topk(q, v, 10, None).collect()}
    got = retrieve.vector_topk_lsh(q, v, 10, report=True).collect()
    assert len(want & {(r.query_id, r.note_id) for r in got}) >= 0.9 * len(want) == 0.9 * len(got)
    compared = {r.query_id: r.compared for r in got}
    assert sum(compared.values()) < 0.2 * n * len(compared) and max(compared.values()) < n


def test_lsh_of_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), (7, []), (8, [-1.0, 0.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.rank, r.note_id) for r in retrieve.vector_topk_lsh(v.where("vec_id = 1"), v, 2).collect()]
    assert sorted(got) == [(1, "1"), (2, "2")]
    assert retrieve.vector_topk_lsh(v, v.limit(0), 2).count() == 0


def test_recall_answers_a_question_and_drops_expired_notes(spark):
    n = spark.createDataFrame([("n1", "APT28 uses Mimikatz", "2024-01-01", "knowledge"), ("n2", "APT28 uses Metasploit", "2020-01-01", "memory"), ("n3", "unrelated weather", "2024-01-01", "knowledge")], "note_id string, content_raw string, created_at string, persistence string").withColumn("created_at", F.to_timestamp("created_at"))
    q = spark.createDataFrame([(1, "What tools does APT28 use?")], "query_id int, text string")
    got = [r.note_id for r in retrieve.recall(q, n, extract.extract_all_long(n), 5, "2024-02-01").orderBy("rank").collect()]
    assert got[0] == "n1" and "n2" not in got


def test_recall_equals_plain_python(spark):
    """Every step of the retrieval again, one question at a time."""
    import datetime

    day = datetime.datetime(2024, 1, 1)
    texts = ["APT28 uses Mimikatz", "APT28 uses Metasploit in 2023", "APT29 exploited CVE-2024-0001", "weather is fine", "Fancy Bear dropped Mimikatz", "CVE-2024-0001 in 2023 by APT28"]
    made = [(f"n{i:02}", f"{texts[i % 6]} case {i % 4}", day + datetime.timedelta(days=i % 9), ("knowledge", "memory")[i % 5 == 0]) for i in range(40)]
    n = spark.createDataFrame(made, "note_id string, content_raw string, created_at timestamp, persistence string")
    asks = ["What tools does APT28 use?", "When did APT28 act before or after 2023?", "Why did APT28 succeed because of what?", "What is CVE-2024-0001?", "fine weather case 2", "hello", "", "Tell me about Mimikatz and APT29"]
    q = spark.createDataFrame(list(enumerate(asks)), "query_id int, text string")
    idx = extract.extract_all_long(n)
    resolved = extract.resolve_alias(idx).select("note_id", "entity_type", F.col("canonical").alias("entity_value")).distinct()
    known = [(r.entity_type, r.entity_value, r.note_id) for r in resolved.collect()]
    links = [(f"n{i:02}", f"n{i + 1:02}") for i in range(0, 39, 3)]
    edges = [(f"{t}:{v}", f"note:{m}", "MENTIONED_IN", "causal" if v == "apt28" and m < "n10" else "heuristic") for t, v, m in known]
    gone, k, as_of = {"n01", "n06"}, 6, "2024-02-05"
    e = spark.createDataFrame(edges, "from_id string, to_id string, relationship string, edge_type string")
    got = retrieve.recall(q, n, idx, k, as_of, spark.createDataFrame([(g,) for g in gone], "note_id string"), e, spark.createDataFrame(links, "note_id string, related string")).collect()

    vec = {r.note_id: list(r.vector) for r in retrieve.embed_batch(n, "note_id", "content_raw").collect()}
    qvec = {r.query_id: list(r.vector) for r in retrieve.embed_batch(q, "query_id", "text").collect()}
    intent = {r.query_id: r for r in retrieve.traversal_policy(q.select("query_id", retrieve.classify_intent(F.col("text"))["intent"].alias("intent"))).collect()}
    ents = {}
    for r in extract.resolve_alias(extract.extract_all_long(q, "text", "query_id")).collect():
        ents.setdefault(r.query_id, set()).add((r.entity_type, r.canonical))
    content, made_at = {m[0]: m[1] for m in made}, {m[0]: m[2] for m in made}
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1
    spread = lambda d: {x: 0.5 if max(d.values()) - min(d.values()) < 1e-9 else (s - min(d.values())) / (max(d.values()) - min(d.values())) for x, s in d.items()}
    best = lambda d: sorted(d, key=lambda x: (-d[x], x))
    want = []
    for i, text in enumerate(asks):
        mine = ents.get(i, set())
        cos = {x: round(sum(a * b for a, b in zip(v, qvec[i])) / norm(v) / norm(qvec[i]), 9) for x, v in vec.items()}
        cos = {x: s for x, s in cos.items() if s >= 0.15}
        top = {x: cos[x] for x in best(cos)[:k]}
        top = {x: s * 2.5 ** len({v for _, v in mine} & {v for _, v, m in known if m == x}) for x, s in top.items()}
        new = {}
        for a, b in links:
            if a in top and b not in top:
                new[b] = max(new.get(b, 0), top[a] / 2)
        top |= {x: new[x] for x in best(new)[: 20 - len(top)]}
        walked = {m: 0.5 for t, v, m in known if (t, v) in mine}
        vs, gs = (spread(d) if d else {} for d in (top, walked))
        fused = {x: round(vs.get(x, 0) * intent[i].vector + gs.get(x, 0) * intent[i].graph, 9) for x in vs.keys() | gs.keys()}
        out = best(fused)[:k]
        if len(out) < len(top):
            year = "2023" if intent[i].intent == "temporal" and "2023" in text else None
            out = sorted(top, key=lambda x: (not (year and (year in content[x] or year == str(made_at[x].year))), -top[x], x))[:k]
        if intent[i].intent == "causal":
            starts = {f"{t}:{v}" for t, v in mine}
            out += sorted({b[5:] for a, b, _, kind in edges if kind == "causal" and a in starts} - set(out))
        hits = {}
        for t, v in mine:
            for rank, x in enumerate(sorted({m for a, b, m in known if (a, b) == (t, v)}, key=lambda x: (-made_at[x].timestamp(), x))[:3], 1):
                hits[x] = min(hits.get(x, 9), rank)
        out += sorted(hits.keys() - set(out), key=lambda x: (hits[x], x))
        asked_words = set(text.lower().split())
        share = {x: round(len(asked_words & set(content[x].lower().split())) / max(len(asked_words), 1), 9) for x in out}
        out = sorted(out, key=lambda x: (-share[x], out.index(x)))
        old = lambda x: made[int(x[1:])][3] == "memory" and (datetime.date.fromisoformat(as_of) - made_at[x].date()).days > dict(TTL_DAYS)["memory"]
        want += [(i, r, x) for r, x in enumerate([x for x in out if x not in gone and not old(x)][:k], 1)]
    assert sorted(tuple(r) for r in got) == want and len({r.query_id for r in got}) >= 6


def test_supersession_replay_and_shift_follow_order(spark):
    n = spark.createDataFrame([("a", "s", 1), ("b", "s", 2), ("c", "s", 3)], "note_id string, stream string, t int").withColumn("created_at", F.timestamp_seconds("t"))
    i = spark.createDataFrame([("cve", "x", "a"), ("cve", "x", "b"), ("cve", "x", "c")], "entity_type string, entity_value string, note_id string")
    assert rows(evolve.supersession_replay(n, i)) == [("s", "a", "b"), ("s", "b", "c"), ("s", "c", None)]
    seen = [(f"n{k}", "s", k, ["cve:1"], "cti") for k in range(4)] + [("n4", "s", 4, ["cve:9"], "cti")]
    d = spark.createDataFrame(seen, "note_id string, stream string, t int, entities array<string>, domain string").withColumn("created_at", F.timestamp_seconds("t"))
    got = {r.note_id: r.signals for r in evolve.shift_detect(d).collect()}
    assert got["n4"] == "entity_novelty" and got["n3"] == "" and got["n2"] == ""


def test_supersession_replay_crosses_months(spark):
    made = [("a", "2024-01-30", ["x"]), ("b", "2024-02-02", ["x", "y"]), ("c", "2024-05-01", ["z"]), ("d", "2024-09-01", ["y"]), ("e", "2024-02-03", [])] + [(f"k{k:02}", f"2025-{k:02}-01", [f"p{k}", f"p{k + 1}"]) for k in range(1, 12)]
    n = spark.createDataFrame([m[:2] for m in made], "note_id string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    i = spark.createDataFrame([("cve", e, m[0]) for m in made for e in m[2]], "entity_type string, entity_value string, note_id string")
    got = rows(evolve.supersession_replay(evolve.entity_components(n, i), i))
    assert got == sorted([("a", "a", "b"), ("a", "b", "d"), ("a", "d", None), ("c", "c", None), ("e", "e", None)] + [("k01", f"k{k:02}", f"k{k + 1:02}" if k < 11 else None) for k in range(1, 12)])


def test_supersession_replay_equals_one_pass_over_all_notes(spark, sf_dir):
    from notelattice.plans import QUERIES
    from notelattice.plans.derived import Tables
    from notelattice.plans.notes import entity_index

    t = Tables(spark, sf_dir)
    whole = {(r.note_id, r.superseded_by) for r in evolve.supersession_replay(t.notes.withColumn("stream", F.lit("all")), entity_index(t)).collect()}
    assert {(r.note_id, r.superseded_by) for r in QUERIES["supersession_replay"](spark, sf_dir).collect()} == whole


def one_pass(notes, held):
    """Notes applied one by one: (note, the one that replaced it)."""
    live, by = {}, {}
    for name, at in sorted(notes, key=lambda x: (x[1], x[0])):
        shared = {o: len(held[name] & held[o]) for o in live if held[name] & held[o]}
        if shared:
            old = min(shared, key=lambda o: (-shared[o] - min((at - live[o]).total_seconds() / 86400, 1.0), -live[o].timestamp(), o))
            by[old] = name
            del live[old]
        live[name] = at
    return {(name, by.get(name)) for name, _ in notes}


@pytest.mark.parametrize("size", [2, 17, 1000])
def test_supersession_replay_in_slices_equals_one_pass(spark, size):
    rng = random.Random(size)
    made = [(f"n{k:03}", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randrange(400))) for k in range(30 if size < 3 else 90)]
    held = {n: {f"hot{rng.randrange(3)}" if rng.random() < 0.6 else f"e{rng.randrange(12)}" for _ in range(rng.randrange(4))} for n, _ in made}
    n = spark.createDataFrame([(*m, "all") for m in made], "note_id string, created_at timestamp, stream string")
    i = spark.createDataFrame([("tool", e, name) for name, es in held.items() for e in es], "entity_type string, entity_value string, note_id string")
    assert {(r.note_id, r.superseded_by) for r in evolve.supersession_replay(n, i, size=size).collect()} == one_pass(made, held)


@pytest.mark.parametrize("idle", [None, 30.0])
def test_shift_detect_in_slices_equals_one_pass(spark, idle):
    rng = random.Random(7)
    made = [(f"n{k:03}", f"s{rng.randrange(3)}" if k % 9 else None, datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.choice([0, 1, 5]) + k // 2), rng.choice(["cti", "general"]), [f"e{rng.randrange(5)}" for _ in range(2)] if k % 7 else None) for k in range(120)]
    d = spark.createDataFrame(made, "note_id string, stream string, created_at timestamp, domain string, entities array<string>")
    want, states = {}, {}
    for name, stream, at, domain, entities in sorted(made, key=lambda m: (m[2], m[0])):
        state = states.get(stream) or evolve.ShiftState(idle=idle)
        signals, states[stream] = state.take(sorted(entities or []), domain, at.timestamp())
        want[name] = ",".join(signals)
    assert len(set(want.values())) > 2
    for size in (7, 1000) if idle else (13,):
        assert {r.note_id: r.signals for r in evolve.shift_detect(d, size=size, idle=idle).collect()} == want


def test_shift_stream_equals_batch_and_forgets(spark, sf_dir):
    from notelattice.plans import QUERIES

    batch = {r.note_id: r.signals for r in QUERIES["shift_detect"](spark, sf_dir).collect()}
    stream = QUERIES["stream_shift"](spark, sf_dir).collect()
    assert {r.note_id: r.signals for r in stream} == batch and len({r.stream for r in stream}) > 20
    assert max(r.held for r in stream) > 0 and "entity_novelty" in set(batch.values())


def test_scores_read_whole_texts(spark, tmp_path):
    from notelattice.plans import QUERIES

    gold = " ".join(f"g{k}" for k in range(400))
    said = " ".join(f"p{k}" for k in range(400)) + " " + gold  # what is wanted lies beyond any prefix
    spark.createDataFrame([(1, 0, "user", gold), (1, 1, "assistant", said)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    first = lambda name: QUERIES[f"whole_{name}"](spark, str(tmp_path)).first()
    assert (first("keyword_judge").score, first("substring_match").score, first("attribution_score").score, first("exact_match").score) == (1, 1, 1, 0)
    assert first("keyword_presence").presence == first("context_precision").precision == 1 and first("normalize_answer").answer == said
    f1, prf, recall = first("token_f1"), first("set_prf"), first("set_recall_in_text")
    assert (f1.precision, f1.recall, prf.precision, prf.recall, recall.found, recall.wanted) == (0.5, 1, 0.5, 1, 400, 400)
    assert first("best_of_gold").gold_id == "1:1" and {r.mean_score for r in QUERIES["whole_accuracy_by_category"](spark, str(tmp_path)).collect()} == {1}


def test_negative_questions_of_many_tools(spark):
    index = [("intrusion_set", "apt-1", n) for n in ("a", "b")] + [("tool", "t0", n) for n in ("a", "b")] + [("tool", f"t{k}", "c") for k in range(1, 80)]
    got = evaluate.generate_qa(spark.createDataFrame(index, "entity_type string, entity_value string, note_id string"))
    assert rows(got.where("kind = 'negative'").select("question")) == sorted((f"Does apt-1 use t{k}?",) for k in range(1, 80))


def test_contradictions_equal_pairs(spark):
    data = [(f"n{k}", "never" if k % 3 == 0 else "uses", k % 5, k // 2) for k in range(40)]
    n = spark.createDataFrame(data, "note_id string, content_raw string, e int, t int").withColumn("created_at", F.timestamp_seconds("t"))
    i = n.select(F.lit("tool").alias("entity_type"), F.col("e").cast("string").alias("entity_value"), "note_id")
    want = set()
    for a in data:
        for b in data:
            if a[2] == b[2] and (a[1] == "never") != (b[1] == "never") and (a[3], a[0]) < (b[3], b[0]):
                want.add(a[0])
    assert {r[0] for r in evolve.contradictions(n, i).collect()} == want


def test_causal_chain_expands_nodes_at_the_last_depth(spark):
    e = spark.createDataFrame([(f"{k}", f"{k + 1}", "causes", "causal") for k in range(9)], "from_id string, to_id string, relationship string, edge_type string")
    s = spark.createDataFrame([("0",)], "node string")
    assert max(r.depth for r in graph.causal_chain(e, s, True, 3).collect()) == 3
    assert len(graph.causal_chain(e, s, True, 3, 2).collect()) == 2


def test_cycles_are_found(spark):
    old = spark.createDataFrame([("a", "b"), ("b", "c")], "from_id string, to_id string")
    new = spark.createDataFrame([("c", "a"), ("c", "d"), ("x", "x")], "from_id string, to_id string")
    assert rows(ontology.acyclic_check(old, new)) == [("c", "a"), ("x", "x")]


def test_cycles_equal_brute_force(spark):
    rng = random.Random(2)
    for nodes, old_n, new_n in ((12, 20, 25), (40, 60, 40)):
        pick = lambda: (f"{rng.randrange(nodes):02}", f"{rng.randrange(nodes):02}")
        old, new = {pick() for _ in range(old_n)}, {pick() for _ in range(new_n)}

        def reaches(a, b):
            todo, seen = [a], set()
            while todo:
                x = todo.pop()
                if x == b:
                    return True
                if x not in seen:
                    seen.add(x)
                    todo += [y for z, y in old if z == x]
            return False

        frame = lambda links: spark.createDataFrame(sorted(links), "from_id string, to_id string")
        assert rows(ontology.acyclic_check(frame(old), frame(new))) == sorted(e for e in new if reaches(e[1], e[0]))
    assert ontology.acyclic_check(frame(old).limit(0), frame(new).where("from_id <> to_id").limit(1)).count() == 0


def test_order_statistics_equal_sorting(spark):
    from notelattice.functions.quantiles import order_statistics

    rng = random.Random(5)
    groups = {"ties": [3.0] * 50, "many": [rng.gauss(0, 1e6) for _ in range(3000)], "wide": [-1e308, 1e308, 0.0, 1e-300, -1e-300], "one": [7.0], "two": [1.0, 2.0, 2.0]}
    data = [(g, x) for g, xs in groups.items() for x in xs] + [("ties", None), ("many", float("nan")), (None, 1.0)]
    wanted = [(g, k) for g, xs in groups.items() for k in {0, len(xs) // 2, len(xs) - 1, len(xs), -1}] + [(None, 0), ("none", 0)]
    got = order_statistics(spark.createDataFrame(data, "g string, x double"), "g", "x", spark.createDataFrame(wanted, "g string, k long"))
    assert rows(got) == sorted((g, k, sorted(groups[g])[k]) for g, k in wanted if g in groups and 0 <= k < len(groups[g]))


def test_prefixes_of_any_length(spark):
    i = spark.createDataFrame([("tool", v, f"n{k % 4}") for k, v in enumerate(["a", "ab", "abc", "abcd", "abce", "b", "abcd"])] + [("cve", "ab", "n1")], "entity_type string, entity_value string, note_id string")
    p = spark.createDataFrame([("",), ("a",), ("AB",), ("abc",), ("abcd",), ("zz",), (None,)], "prefix string")
    got = index.search_entities_prefix(i, p, 3)
    values = sorted({(r.entity_type, r.entity_value) for r in i.collect()})
    want = []
    for q in ("", "a", "AB", "abc", "abcd"):
        for kind in ("tool", "cve"):
            want += [(q, kind, v, 2 if v == "abcd" else 1) for t, v in values if t == kind and v.startswith(q.lower())][:3]
    assert rows(got) == sorted(want)


def test_keyword_inject_with_common_words_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = ["common", "frequent", "usual"] + [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(rng.choice(vocabulary[:3]) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(n))
    notes_, asked = [(f"n{k:02}", text(8)) for k in range(60)], [(k, text(1 + k % 4) + " the What") for k in range(25)]
    found = [(k, f"n{rng.randrange(60):02}") for k in range(25) for _ in range(k % 5)]
    want = []
    for q, t in asked:
        words = set(t.lower().split()) - {"the", "what"}
        scored = sorted((-len(words & set(c.split())), n) for n, c in notes_ if words & set(c.split()) and (q, n) not in found)
        want += [(q, r + 1, n, -s) for r, (s, n) in enumerate(scored[:3])]
    frame = spark.createDataFrame
    got = retrieve.keyword_inject(frame(asked, "query_id int, text string"), frame(notes_, "note_id string, content_raw string"), frame(found, "query_id int, note_id string").distinct(), 3, rare=12)
    assert rows(got) == sorted(want)


def test_walks_hold_their_edges(spark):
    e = spark.createDataFrame([("a", "b", "r"), ("a", "b", "q"), ("b", "a", "r"), ("b", "c", "r"), ("c", "d", "r")], "from_id string, to_id string, relationship string")
    got = graph.traverse_paths(e, spark.createDataFrame([("a",), ("z",)], "node string"), 2)
    paths = sorted(r[0] for r in got.select(graph.path_text(F.col("path"))).collect())
    assert paths == ["a -[q]-> b", "a -[q]-> b -[r]-> a", "a -[q]-> b -[r]-> c", "a -[r]-> b"]


def test_sigma_tags(spark):
    t = spark.createDataFrame([("r", "attack.t1059.001"), ("r", "cve.2024.3094"), ("r", "tlp.red"), ("r", None), ("r", "")], "rule_id string, tag string")
    got = {r.tag: (r.entity_type, r.entity_value) for r in rules.sigma_tag_resolve(t).collect()}
    assert got["attack.t1059.001"] == ("AttackPattern", "T1059.001") and got["cve.2024.3094"] == ("Vulnerability", "CVE-2024-3094") and got["tlp.red"][0] is None


def test_readers(spark, tmp_path):
    (tmp_path / "notes.jsonl").write_text('{"note_id": "a", "updated_at": "1", "x": 1}\n{"note_id": "a", "updated_at": "2", "x": 2}\nbroken\n')
    good, bad = tables.read_notes_jsonl(spark, str(tmp_path / "notes.jsonl"), "note_id string, updated_at string, x int")
    assert rows(good) == [("a", "2", 2)] and bad.count() == 1
    (tmp_path / "rules").mkdir()
    (tmp_path / "rules" / "a.yml").write_text("title: t\ntags: [attack.t1059]\n")
    (tmp_path / "rules" / "b.yaml").write_text("- not a mapping\n")
    got = {r.path[-6:]: (r.document, r.error) for r in tables.read_sigma_rules(spark, str(tmp_path / "rules")).collect()}
    assert json.loads(got["/a.yml"][0])["title"] == "t" and got["b.yaml"][1]
    (tmp_path / "yara").mkdir()
    (tmp_path / "yara" / "x.yar").write_text('import "pe"\nrule One : APT T1059 {\n meta:\n  author = "me = you"\n  version = "1.0"\n strings:\n  $a = "x"\n condition:\n  $a\n}\nrule Two {\n condition:\n  true\n}\n')
    y = {r.name: r for r in tables.read_yara_rules(spark, str(tmp_path / "yara")).collect()}
    assert y["One"].meta == {"author": "me = you", "version": "1.0"} and y["One"].tags == ["APT", "T1059"] and y["Two"].tags == []
    bundle = {"objects": [{"type": "attack-pattern", "name": "n", "external_references": [{"source_name": "mitre-attack", "external_id": "T1"}]}, {"type": "attack-pattern", "name": "s", "external_references": [{"source_name": "mitre-attack", "external_id": "T1.001"}]}, {"type": "attack-pattern", "name": "r", "revoked": True, "external_references": [{"source_name": "mitre-attack", "external_id": "T2"}]}]}
    (tmp_path / "stix.json").write_text(json.dumps(bundle))
    assert rows(tables.read_stix_bundle(spark, str(tmp_path / "stix.json"))) == [("T1", "n")]
    (tmp_path / "hunt.md").write_text("---\nhunt_id: H-1\n---\n## LEARN\nabc\n## CHECK\n10.0.0.1\n")
    assert [(r.hunt_id, r.learn, r.check) for r in tables.read_hunt_markdown(spark, str(tmp_path / "hunt.md")).collect()] == [("H-1", "abc", "10.0.0.1")]


def test_compaction_keeps_rows(spark, tmp_path):
    spark.range(100).repartition(10).write.parquet(str(tmp_path / "a"))
    got = {r.stage: (r.files, r.rows) for r in tables.compact_files(spark, str(tmp_path / "a"), str(tmp_path / "b"), 2).collect()}
    assert got == {"before": (10, 100), "after": (2, 100)}


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", F.col("value").alias("duration_ms"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream.groupBy("event_type").count().writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("counts")) == rows(events.groupBy("event_type").count())
    q = jobs.stream_telemetry(stream, "1 day", "1 hour").writeStream.outputMode("append").format("memory").queryName("tel").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tel").count() > 0


def test_stream_ingest_writes_each_table(spark, sf_dir, tmp_path):
    from notelattice.plans.derived import Tables

    t = Tables(spark, sf_dir)
    t.notes.limit(50).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.notes.schema).parquet(str(tmp_path / "in"))
    q = jobs.stream_ingest(stream, str(tmp_path / "out"), str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    n = spark.read.parquet(str(tmp_path / "out" / "notes"))
    assert n.count() == 50 and spark.read.parquet(str(tmp_path / "out" / "kg_edges")).count() > 0


def test_stream_shift_equals_batch(spark, tmp_path):
    data = [(f"n{k}", "s", float(k), "cti", ["cve:9" if k == 4 else "cve:1"]) for k in range(6)]
    d = spark.createDataFrame(data, "note_id string, stream string, at double, domain string, entities array<string>")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = jobs.stream_shift(stream).writeStream.outputMode("append").format("memory").queryName("shift").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    batch = evolve.shift_detect(d.withColumn("created_at", F.timestamp_seconds("at"))).select("stream", "note_id", "signals")
    assert rows(spark.table("shift")) == rows(batch)


def test_supersession_with_hot_entities_equals_brute_force(spark):
    from notelattice.operators.evolve import supersession_candidates

    rng = random.Random(3)
    notes = [(f"n{k}", rng.randrange(10) * 43_200) for k in range(60)]
    ents = {i: {("tool", "t")} | {("cve", f"c{rng.randrange(8)}") for _ in range(rng.randrange(3))} if rng.random() < 0.9 else set() for i, _ in notes}
    index = spark.createDataFrame([(t, v, i) for i, e in ents.items() for t, v in e] + [("domain", "d", i) for i in ents], "entity_type string, entity_value string, note_id string")
    table = spark.createDataFrame(notes, "note_id string, at long").selectExpr("note_id", "timestamp_seconds(at) AS created_at")
    for live in (table, table.where("note_id <> 'n7' AND note_id <> 'n20'")):
        alive = {r.note_id for r in live.collect()}
        want = set()
        for i, at in notes:
            found = [(len(ents[i] & ents[j]) + max(0.0, min(1.0, (at - b) / 86400)), b, j) for j, b in notes if j != i and j in alive and ents[i] & ents[j]]
            if found:
                score, _, j = min(found, key=lambda x: (-x[0], -x[1], x[2]))
                want.add((i, j, round(score, 9)))
        for hot in (1, 5, 1000):
            assert {tuple(r) for r in supersession_candidates(table, live, index, hot=hot).collect()} == want


def test_log_tail_takes_each_line_once(spark, tmp_path):
    from notelattice.sources.logtail import read_log_stream

    log, got = tmp_path / "app.log", []
    log.write_text("one\ntwo\nhal")

    def run():
        q = read_log_stream(spark, f"{tmp_path}/app.log*").writeStream.foreachBatch(lambda batch, n: got.extend(r.line for r in batch.collect())).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert sorted(got) == ["one", "two"]
    with log.open("a") as f:
        f.write("f\nthree\n")
    log.rename(tmp_path / "app.log.1")  # rotated with lines that were not read yet
    log.write_text("four\n")
    run()
    assert sorted(got) == ["four", "half", "one", "three", "two"]
    log.write_text("5\n")  # cut
    run()
    assert sorted(got) == ["5", "four", "half", "one", "three", "two"]


def test_bucket_table_rewrites_what_changes(spark, tmp_path):
    from notelattice.sources.buckets import BucketTable

    table = BucketTable(spark, str(tmp_path / "t"), "k", "at", 8)
    frame = lambda data: spark.createDataFrame(data, "k string, at int, v string")
    assert table.read(schema="k string").count() == 0 and table.delete(frame([("a", 1, "x")])) == 0
    assert table.upsert(frame([(f"k{i}", 1, "old") for i in range(800)] + [(None, 1, "x")])) == 800
    table.snapshot("first")
    assert table.upsert(frame([("k5", 2, "new"), ("k5", 0, "late"), ("k9", 0, "late")])) < 300  # one or two buckets of eight
    assert {r.k: r.v for r in table.read().where("k IN ('k5', 'k9')").collect()} == {"k5": "new", "k9": "old"} and table.read().count() == 800
    assert table.delete(frame([("k5", 0, "")])) < 200 and table.read().count() == 799
    assert table.read("first").where("v = 'old'").count() == 800 and table.version() == 3
    table.delete(table.read())
    assert table.read(schema="k string").count() == 0


def test_access_counts_of_several_batches(spark):
    updates = spark.createDataFrame([("a", 1, 2, 5), ("a", 1, 3, 6), ("a", 2, 1, 9), ("b", 1, 1, 1)], "note_id string, start int, access_count int, last_accessed int")
    held = spark.createDataFrame([("a", 10, 0), ("c", 1, 0)], "note_id string, access_count int, last_accessed int")
    assert rows(jobs.merge_access_counts(held, updates)) == [("a", 14, 9), ("b", 1, 1), ("c", 1, 0)]


@pytest.mark.parametrize("split", [700, 5000, 1 << 27])
def test_bundles_in_splits_equal_json(spark, tmp_path, split):
    rng = random.Random(split)
    odd = ['}', '{"', '\\', '\\"', '"}', "[{", "é}😀", "\n}", "\\\\", ""]
    want = []
    for k in range(4):
        objects = []
        for n in range((0, 1, 60, 300)[k]):
            o = {"type": "report", "id": f"{k}-{n}", "name": "".join(rng.choice(odd) for _ in range(rng.randint(0, 40))), "aliases": [rng.choice(odd) for _ in range(rng.randint(0, 3))]}
            o["deep"] = {"a": [{"b": {"c": "}"}}, [[{}]]]}
            if n % 50 == 7:
                o["description"] = '}{"\\' * 2000  # longer than a split
            objects.append(o)
        want += [(o["id"], o["name"], o["aliases"], o.get("description")) for o in objects]
        bundle = {"type": "bundle", "id": "x{[\"", "spec": {"a": {"b": 1}}, "objects": objects}
        (tmp_path / f"b{k}.json").write_text(json.dumps(bundle, indent=rng.choice([None, 2]), ensure_ascii=k % 2 == 0))
    (tmp_path / "cut.json").write_text('{"objects": [{"type": "report", "id": "before", "name": "n", "aliases": []}, {"type": "report", "id": "bro')
    (tmp_path / "none.json").write_text("")
    want.append(("before", "n", [], None))
    conf = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "10", "spark.sql.execution.arrow.maxRecordsPerBatch": "37"}
    held = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        rows = read_objects(spark, str(tmp_path), "type string, id string, name string, aliases array<string>, description string")
        assert split > 5000 or spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = [(r["id"], r["name"], r["aliases"], r["description"]) for r in rows.collect()]
    finally:
        for c, v in held.items():
            spark.conf.set(c, v)
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("size", [3, 5000])
def test_ingest_supersedes_across_batches(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(jobs, "supersession_replay", lambda *a, **k: evolve.supersession_replay(*a, size=size, **k))
    rng = random.Random(size)
    tools, start = ["mimikatz", "cobalt strike", "metasploit"], datetime.datetime(2024, 1, 1)
    made = []
    for b in range(4):
        for k in range(8):
            text = " and ".join({rng.choice(tools), f"CVE-2024-{1000 + rng.randrange(4)}"}) if rng.random() < 0.9 else "nothing here"
            made.append((b, f"n{b}{k}", start + datetime.timedelta(hours=rng.randrange(90)), text))  # later batches hold older notes too
    schema = "note_id string, created_at timestamp, content_raw string, domain string"
    source = str(tmp_path / "in")
    for b in range(4):
        spark.createDataFrame([(*m[1:], "cti") for m in made if m[0] == b], schema).coalesce(1).write.mode("append").parquet(source)
        q = jobs.stream_ingest(spark.readStream.schema(schema).parquet(source), str(tmp_path / "out"), str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    held = {}
    for kind, value, name in rows(spark.read.parquet(str(tmp_path / "out" / "entity_index")).select("entity_type", "entity_value", "note_id")):
        if kind in evolve.SUPERSEDING:
            held.setdefault(name, set()).add((kind, value))
    live, by = {}, {}
    for _, name, at, _ in sorted(made, key=lambda m: (m[0], m[2], m[1])):
        shared = {o: len(held.get(name, set()) & held.get(o, set())) for o in live}
        score = lambda o: shared[o] + max(0.0, min((at - live[o]).total_seconds() / 86400, 1.0))  # noqa: E731, B023
        if any(shared.values()):
            old = min((o for o in shared if shared[o]), key=lambda o: (-score(o), -live[o].timestamp(), o))
            by[old] = name
            del live[old]
        live[name] = at
    got = spark.read.parquet(str(tmp_path / "out" / "superseded")).select("note_id", "superseded_by").collect()
    assert {r.note_id: r.superseded_by for r in got} == by and len(got) == len(by) > 10 and any(a[1] != b[1] for a, b in by.items())
    edges = spark.read.parquet(str(tmp_path / "out" / "kg_edges")).where("relationship = 'SUPERSEDES'").select("to_value", "from_value")
    assert {tuple(r) for r in edges.collect()} == set(by.items())
    every = {r.note_id for r in spark.read.parquet(str(tmp_path / "out" / "entity_index")).collect()}
    assert {r.note_id for r in jobs.live_index(spark, str(tmp_path / "out")).collect()} == every - set(by)


def test_ingest_in_one_batch_equals_the_replay(spark, sf_dir):
    from notelattice.plans import QUERIES
    from notelattice.plans.derived import Tables
    from notelattice.plans.notes import entity_index

    t = Tables(spark, sf_dir)
    want = evolve.supersession_replay(t.notes.withColumn("stream", F.lit("all")), entity_index(t)).where("superseded_by IS NOT NULL")
    assert rows(QUERIES["stream_ingest_superseded"](spark, sf_dir)) == rows(want.select("note_id", "superseded_by"))


def test_pii_equals_plain_python(spark):
    rng = random.Random(5)
    bits = ["a.b@evil.com", "x@y.org", "+1 (555) 123-4567", "(555) 123-4567", "10.0.0.1", "999.1.1.1", "evil.example.com", "a@b", "é", " ", ", ", "@", "\n", "mail", "555"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(300)] + [None, "", "x@y.org x@y.org"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for exempt in (True, False):
        want = []
        for k, t in enumerate(texts):
            spans = [(m.start(), m.end(), kind, m.group(), score) for kind, p, score, indicator in notes.PII if not (indicator and exempt) for m in re.finditer(p, t or "")]
            kept = []
            for s in sorted(spans, key=lambda s: (s[0] - s[1], -s[4], s[0])):
                if not any(s[0] < o[1] and s[1] > o[0] for o in kept):
                    kept.append(s)
            want += [(k, s[2], s[0], s[1], s[3]) for s in kept]
        assert rows(notes.pii_detect(df, "k", "t", exempt)) == sorted(want) and len(want) > 100


def test_embedding_and_repair_equal_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "Same same, SAME.")], docs.schema))
    texts = {r.doc_id: r.text for r in docs.collect()}

    def plain(text):
        out = [0.0] * retrieve.DIM
        for word in (text or "").lower().split():
            h = zlib.crc32(word.strip(".,;:!?").encode())
            out[h % retrieve.DIM] += 1.0 if (h >> 16) % 2 else -1.0
        return out

    want = {k: plain(t) for k, t in texts.items()}
    made = retrieve.embed_batch(docs, "doc_id", "text")
    assert {r.doc_id: r.vector for r in made.collect()} == want and sorted(map(abs, want[-3]))[-2:] == [0, 3]
    broken = docs.join(made, "doc_id").withColumn("vector", F.when(F.col("doc_id") % 2 == 0, F.array().cast("array<float>")).when(F.col("doc_id") % 3 == 0, F.col("vector")).otherwise(F.transform("vector", lambda x: x + 1)))
    given = {r.doc_id: r.vector for r in broken.collect()}
    got = retrieve.repair_embeddings(broken, "doc_id", "text", "vector", F.size("vector") == retrieve.DIM).collect()
    assert {r.doc_id: (r.vector, r.repaired) for r in got} == {k: (given[k] or want[k], not given[k]) for k in texts}


def test_notes_are_not_broadcast_by_the_size_of_their_file(spark):
    t = Tables(spark, "/root/testdata/sf0.1")
    for joined in (entity_index(t).join(t.notes.select("note_id", "created_at"), "note_id"), t.notes.select("note_id").join(entity_index(t), "note_id", "left_semi")):
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()


def test_supersession_looks_at_no_pairs_of_notes(spark):
    # one set of 20,000 notes at times of their own: pairs would be 400 million rows
    table = spark.range(20_000).select(F.format_string("n%05d", "id").alias("note_id"), F.timestamp_seconds(F.col("id") * 600).alias("created_at"))
    index = table.select(F.lit("tool").alias("entity_type"), F.lit("x").alias("entity_value"), "note_id")
    got = evolve.supersession_candidates(table, table, index)
    day = 144
    want = [(f"n{k:05d}", f"n{k - day if k >= day else 0 if k else 19_999:05d}", round(1 + min(k / day, 1), 9)) for k in range(20_000)]
    assert rows(got) == want


def test_actor_recall_equals_brute_force_and_cuts_lists(spark):
    rng = random.Random(5)
    kinds = ("actor", "threat_actor", "intrusion_set", "tool")
    notes_ = [(f"n{k:03d}", rng.randrange(30)) for k in range(200)]
    ents = [(rng.choice(kinds), f"a{rng.randrange(4)}", i) for i, _ in notes_ for _ in range(3)]
    asked_ = [(q, f"A{rng.randrange(5)}") for q in range(12) for _ in range(2)]
    at, want = dict(notes_), []
    for q in range(12):
        of = {v.lower() for x, v in asked_ if x == q}
        best: dict = {}
        for t, v, i in ents:
            if v in of and t != "tool":
                best[i] = min(best.get(i, 9), kinds.index(t))
        ranked = sorted(best, key=lambda i: (best[i], -at[i], i))[:4]
        want += [(q, r + 1, i) for r, i in enumerate(ranked)]
    table = spark.createDataFrame(notes_, "note_id string, t long").select("note_id", F.timestamp_seconds("t").alias("created_at"))
    found = index.recall_actor(spark.createDataFrame(ents, "entity_type string, entity_value string, note_id string"), spark.createDataFrame(asked_, "query_id long, entity_value string"), table, 4)
    assert rows(found) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "WindowGroupLimit [entity_type" in plan or plan.count("row_number()") == 2


def test_listing_counts_notes_of_all_tiers_unless_one_is_named(spark, sf_dir):
    t = Tables(spark, sf_dir)
    want = entity_index(t).where("contains(entity_value, '1')").groupBy("entity_type", "entity_value").count()
    assert QUERIES["entity_listing"](spark, sf_dir).first().total == want.count()
    some = spark.createDataFrame([("tool", "a1", "n1"), ("tool", "a1", "n2"), ("tool", "b1", "n2")], "entity_type string, entity_value string, note_id string")
    tiers = spark.createDataFrame([("n1", "A"), ("n2", "B")], "note_id string, tier string")
    assert rows(index.entity_listing(some, None, "1", 0, 5, "A", tiers)) == [("tool", "a1", 1, 1)]


def test_sweep_counts_equal_questions_once_each(spark):
    scored = [(1, "a", 30.0, 1), (1, "b", 20.0, 0), (2, "a", 30.0, 1), (2, "b", 20.0, 0), (3, "c", 5.0, 2)]
    truth = [(1, "a"), (2, "a"), (3, "c")]
    all_ = retrieve.parameter_sweep(spark.createDataFrame(scored, "query_id int, note_id string, score double, shared int"), spark.createDataFrame(truth, "query_id int, note_id string"), (10.0, 25.0), (1.0, 2.0))
    once = spark.createDataFrame([(1, "a", 30.0, 1, 2), (1, "b", 20.0, 0, 2), (3, "c", 5.0, 2, 1)], "query_id int, note_id string, score double, shared int, asks int")
    wanted = spark.createDataFrame([(1, "a", 2), (3, "c", 1)], "query_id int, note_id string, asks int")
    assert rows(all_) == rows(retrieve.parameter_sweep(once, wanted, (10.0, 25.0), (1.0, 2.0)))
    assert (10.0, 2.0, 3, 5, 0.75) in rows(all_) and (25.0, 1.0, 2, 2, 0.8) in rows(all_)


def test_links_follow_only_where_there_is_room(spark):
    scored = spark.createDataFrame([(1, "a", 4.0), (1, "b", 3.0), (1, "c", 2.0), (2, "a", 4.0)], "query_id int, note_id string, score double")
    links = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z")], "note_id string, related string")
    assert rows(retrieve.expand_links(scored, links, 2)) == [(1, "a", 4.0), (1, "b", 3.0), (2, "a", 4.0), (2, "x", 2.0)]
    assert rows(retrieve.expand_links(scored, links, 4)) == [(1, "a", 4.0), (1, "b", 3.0), (1, "c", 2.0), (1, "x", 2.0), (2, "a", 4.0), (2, "x", 2.0), (2, "y", 2.0)]


def test_notes_of_a_task_are_bounded(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(derived, "ROWS", 100)
    t = Tables(spark, sf_dir)
    sizes = t.notes.select("note_id").groupBy(F.spark_partition_id()).count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 110 and sizes[1] == t.orders.count()


def test_starts_and_needles_change_no_match(spark):
    draw, parts = random.Random(5), ["a", "-", ".", "com", "co", "COM", "new york", "New  York", "paris", "St", "_", " ", "é", "@", ":", "\n", "Ana", "http://", "10.1.2.3", "cve-2024-1", "1234", "ab" * 20, "apt", "9", "x"]
    texts = spark.createDataFrame([(k, "".join(draw.choice(parts) for _ in range(draw.randint(1, 14)))) for k in range(3000)] + [(-1, None)], "k int, t string")
    for kind, plain in PATTERNS.items():
        found = F.regexp_extract_all("t", F.lit(("(?i)" if kind in CASELESS else "") + plain), F.lit(int(kind == "person")))
        values = F.array_distinct(F.transform(found, lambda v: F.replace(F.lower(v), F.lit(" "), F.lit("-"))))
        values = F.array_except(values, F.array(*map(F.lit, NAME_STOPWORDS))) if kind == "person" else F.array_except(values, extract.code_hashes(F.col("t"))) if kind in HASH_TYPES else values
        assert texts.where(~extract.entity_values(F.col("t"), kind).eqNullSafe(values)).isEmpty(), kind


def test_questions_look_for_their_types_once(spark, sf_dir):
    plan = lambda name: QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan("synthesis_result") + plan("keyword_inject")
    assert "https?" not in plan("entity_augment") + plan("blend_rrf")


def test_prefixes_and_questions_read_the_index_once(spark, tmp_path):
    data = [("tool", "m1", "a"), ("tool", "m1", "b"), ("tool", "m1", "b"), ("tool", "m2", "a"), ("intrusion_set", "apt1", "a"), ("intrusion_set", "apt1", "b"), ("actor", "m1", None)]
    spark.createDataFrame(data, "entity_type string, entity_value string, note_id string").write.parquet(f"{tmp_path}/i")
    i, p = spark.read.parquet(f"{tmp_path}/i"), spark.createDataFrame([("M",)], "prefix string")
    scans = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("parquet")
    prefixes, asked = index.search_entities_prefix(i, p), evaluate.generate_qa(i)
    assert scans(prefixes) == 1 and scans(asked) == 0
    assert rows(prefixes) == [("M", "actor", "m1", 0), ("M", "tool", "m1", 2), ("M", "tool", "m2", 1)]
    assert rows(asked.select("kind", "question", "n")) == [("count", "How many notes mention apt1?", 2), ("count", "How many notes mention m1?", 2), ("uses", "Does apt1 use m1?", 2)]


def test_a_replay_extracts_its_types_once(spark, sf_dir, monkeypatch):
    calls, plain = [], extract.extract_all_long
    monkeypatch.setattr(extract, "extract_all_long", lambda *a, **k: calls.append(k.get("kinds", tuple(PATTERNS))) or plain(*a, **k))
    QUERIES["supersession_replay"](spark, sf_dir)
    assert len(calls) == 1 and set(calls[0]) == set(PATTERNS) & set(evolve.SUPERSEDING)


@pytest.mark.parametrize("name", ["minmax_normalize", "temporal_boost", "entity_boost"])
def test_pairs_of_a_question_that_many_ask_are_dealt(spark, tmp_path, name):
    spark.range(9000).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(9000).selectExpr("id AS o_orderkey", "id % 9000 AS o_custkey", "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(int(id % 2000)) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    rows = QUERIES[name](spark, str(tmp_path)).groupBy(F.spark_partition_id().alias("part"), (F.col("query_id") % 6 == 4).alias("metasploit")).count().collect()
    assert sum(r["count"] for r in rows if r["metasploit"]) == 1500 * 2250
    by = Counter()
    for r in rows:
        by[r["part"]] += r["count"]
    assert max(by.values()) < 0.5 * sum(by.values())


def test_give_out_is_the_join(spark, monkeypatch):
    monkeypatch.setattr(fusion, "SIDE", 7)
    answers = spark.range(300).selectExpr("id % 4 AS k", "id AS note_id").union(spark.range(5).selectExpr("9L", "id"))  # 9 has no asker
    askers = spark.range(90).selectExpr("CASE WHEN id < 60 THEN 0 ELSE id % 3 END AS k", "id AS query_id").union(spark.createDataFrame([(8, 500)], "k long, query_id long"))
    given = sorted(map(tuple, fusion.give_out(answers, askers, "k").select("k", "note_id", "query_id").collect()))
    assert given == sorted(map(tuple, answers.join(askers, "k").select("k", "note_id", "query_id").collect())) and len(given) == 75 * 90
    assert fusion.give_out(answers.where("k = 5"), askers, "k").count() == 0


def test_edges_are_made_in_tasks_that_follow_the_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(derived, "EDGE_ROWS", 200)
    most = lambda df, n: max(r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()) < 3 * n
    assert most(QUERIES["neighbors"](spark, sf_dir), 200)
    edges = Tables(spark, sf_dir).kg_edges
    assert all(most(edges.where(F.col("relationship") == r), 200) for r in ("MENTIONED_IN", "USES_TOOL", "EXPLOITS_CVE", "SUPERSEDES"))
    few = graph.neighbors(edges, spark.createDataFrame([("actor:1",), ("actor:1",), (None,)], "node string"), "USES_TOOL", 3)
    assert rows(few) == rows(edges.where("relationship = 'USES_TOOL' AND from_id = 'actor:1'").select("from_id", "relationship", "to_id").distinct()) and few.count() > 0


def test_keyword_inject_answers_every_question(spark, sf_dir):
    asked = {r.query_id for r in Tables(spark, sf_dir).questions.where("text LIKE '%Metasploit%'").collect()}
    assert asked <= {r.query_id for r in QUERIES["keyword_inject"](spark, sf_dir).collect()} and any(q % 50 for q in asked)


def test_recall_answers_equal_texts_once(spark, sf_dir, tmp_path, monkeypatch):
    spark.range(6000).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("orders", "lineitem"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    asked, built, plain, extracted = [], [], retrieve.recall, extract.extract_all_long
    monkeypatch.setattr(retrieve, "recall", lambda q, n, known, *a, **k: asked.append((q, known)) or plain(q, n, known, *a, **k))
    monkeypatch.setattr(extract, "extract_all_long", lambda *a, **k: built.append(a[0]) or extracted(*a, **k))
    got, every = QUERIES["recall"](spark, str(tmp_path)), Tables(spark, str(tmp_path)).questions.where("query_id % 50 = 0")
    (q, known), texts = asked[0], every.select("text").distinct()
    assert rows(q.select("text")) == rows(texts) and texts.count() * 3 < every.count() and len(built) == 2
    assert known._jdf.queryExecution().logical().toString().startswith("LogicalRDD")  # made once
    lists = got.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "note_id"))).alias("notes")).join(every, "query_id")
    per = lists.groupBy("text").agg(F.count_distinct("notes").alias("n"), F.count("*").alias("asks")).collect()
    assert all(r.n == 1 for r in per) and sum(r.asks for r in per) > 3 * len(per)


@pytest.mark.parametrize("runs", [2, 200])
def test_a_stream_of_many_notes_is_ordered_in_bounded_memory(monkeypatch, runs):
    rng, alive, most, of = random.Random(runs), [], [], ShiftState(idle=24.0 * 9)
    monkeypatch.setattr(jobs, "RUNS", runs)
    start = datetime.datetime(2024, 1, 1)
    made = [(start + datetime.timedelta(hours=rng.randrange(20_000)), f"n{k}", rng.choice(["cti", "general"]), [f"e{rng.randrange(9)}" for _ in range(k % 3)] if k % 7 else None) for k in range(26_000)]

    def frames():
        for lo in range(0, len(made), 1000):
            pdf = pd.DataFrame(made[lo : lo + 1000], columns=["at", "note_id", "domain", "entities"])
            alive.append(weakref.ref(pdf))
            most.append(sum(ref() is not None for ref in alive))
            yield pdf

    want = [(at.replace(tzinfo=datetime.timezone.utc).timestamp(), n, d, sorted(e or [])) for at, n, d, e in sorted(made, key=lambda m: m[:2])]
    assert list(jobs.in_order(frames(), 3000)) == want and list(jobs.in_order(iter([]))) == []
    got, kept = jobs.ShiftProcessor("stream", 24.0 * 9, True), []
    for name, part in (("_load", lambda: ShiftState(idle=24.0 * 9)), ("_store", lambda *a: kept.append(a)), ("_wake", lambda: None)):
        setattr(got, name, part)
    outs = list(got.handleInputRows(("s",), frames(), None))
    for (_, note_id, signals, held), (at, n, d, e) in zip((r for o in outs for r in o.itertuples(index=False)), want, strict=True):
        found, of = of.take(e, d, at)
        assert (note_id, signals, held) == (n, ",".join(found), len(of.entities))
    assert max(most) < 5 and max(map(len, outs)) <= jobs.FRAME and len(kept) == 1


def test_a_replay_runs_only_slices_whose_start_changes(spark, monkeypatch):
    ran, plain = [], GroupedData.applyInPandas
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, *a: ran.append(self._df.select("slice").distinct().count()) or plain(self, *a))
    made = [(f"n{k:03}", datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=k // 3)) for k in range(200)]
    held = {n: {f"tool{k % 2}", f"cve{k % 10}"} if k % 50 else {f"own{k}"} for k, (n, _) in enumerate(made)}
    n = spark.createDataFrame([(*m, "all") for m in made], "note_id string, created_at timestamp, stream string")
    i = spark.createDataFrame([("tool", e, name) for name, es in held.items() for e in es], "entity_type string, entity_value string, note_id string")
    assert {(r.note_id, r.superseded_by) for r in evolve.supersession_replay(n, i, size=10).collect()} == one_pass(made, held)
    assert ran[0] == 20 and sum(ran) < 20 * 4


def test_keywords_of_a_text_are_looked_for_once(spark):
    draw, parts = random.Random(3), ["this", "with", "wolf", "WOLF", "lamb", "abc", "night", "night9", "_wolf", "wölf", "ß", "İ", "9", " ", " ", " ", ".", "-", "\n", "́"]
    texts = spark.createDataFrame([(k, "".join(draw.choice(parts) for _ in range(draw.randint(0, 30)))) for k in range(2000)] + [(-1, None)], "k int, t string")
    made = notes.keyword_array(F.col("t"), 3)
    top = notes.keywords_topk(texts, 3, "k", "t").groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "keyword"))), lambda x: x["keyword"]).alias("want"))
    both = texts.join(top, "k", "left").withColumn("want", F.when(F.col("t").isNotNull(), F.coalesce("want", F.array().cast("array<string>"))))
    assert both.where(~made.eqNullSafe(F.col("want"))).isEmpty() and top.count() > 1000
    plan = texts.select(made.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1


def test_patterns_try_few_places(spark):
    assert {"intrusion_set", "tool", "ipv4", "campaign", "actor", "attack_pattern"} <= set(STARTS)
    for kind, start in STARTS.items():
        assert extract.pattern(kind) == ("(?i)" if kind in CASELESS else "") + start + PATTERNS[kind]


def test_chains_end_where_no_node_is_left(spark, monkeypatch):
    cuts, plain = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(df) or plain(df))
    edges = spark.createDataFrame([("a", "b", "r", "causal"), ("a", "c", "r", "causal"), ("c", "d", "r", "heuristic")], "from_id string, to_id string, relationship string, edge_type string")
    starts = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.causal_chain(edges, starts, True, 9)) == [("a", 0, "a", "r", "b"), ("a", 0, "a", "r", "c")]
    assert len(cuts) == 5  # the edges once, and two depths of ten
