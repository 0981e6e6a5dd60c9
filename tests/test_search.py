"""Search on hand-worked memories, and against a plain reading of every signal."""

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from recallforge.functions import embedding, entities
from recallforge.functions.embedding import HashEmbedding
from recallforge.functions.text import TermNumbers, stemmed
from recallforge.operators import search

MEMORY = "id long, namespace string, source_event_id string, content string, importance double, metadata map<string,string>"


def test_entities_of_texts():
    assert {"ann", "old town", "old", "town", "bea"} <= entities.text_names("Ann went to Old Town with Bea")
    assert "the blue gate" in entities.text_names('They call it "the blue gate" here') and entities.text_names("What is it?") == set()
    assert {"ml", "esa", "deep sea"} <= entities.text_names("The ML group of ESA studies the Deep Sea.") and entities.text_names(None) == set()
    assert entities.memory_names("Ann left", "bob\n Old Town ", "Cy", "the x") == ["ann", "bob", "cy", "old town", "the x"]


def test_entity_links(spark):
    rows = [(1, "d", None, "Ann visited Old Town", 0.5, {}), (2, "d", None, "nothing here", 0.5, {"subject": "Ann"}), (3, "d", None, "no names", 0.5, None)]
    stored = entities.enrich(spark.createDataFrame(rows, MEMORY))
    held = {r.id: r.metadata.get("entities") for r in stored.collect()}
    assert held[1] == "ann\nold\nold town\ntown" and held[2] == "ann" and held[3] is None
    asked = spark.createDataFrame([(9, ["ann"]), (8, ["town", "old"]), (7, ["x"])], "query_id long, entities array<string>")
    assert sorted(map(tuple, entities.linked_memories(entities.entity_links(stored), asked).collect())) == [(8, 1), (9, 1), (9, 2)]


def test_hash_embedding(spark):
    e = embedding.HashEmbedding(4)
    assert e.dimensions == 8 and e.embed("") == [0.0] * 8 and abs(sum(x * x for x in e.embed("walking the dog")) - 1) < 1e-9
    assert embedding.cosine([1.0], [1.0, 0.0]) == 0.0 and embedding.cosine([], []) == 0.0
    calls = embedding.FallbackEmbedding(lambda t: 1 / 0, 16)
    assert calls.embed("dog") == embedding.HashEmbedding(16).embed("dogs")
    df = spark.createDataFrame([("dog",), (None,)], "t string").select(embedding.embed_column(embedding.HashEmbedding(8))("t").alias("v"))
    a, b = (r.v for r in df.collect())
    assert a == embedding.HashEmbedding(8).embed("dog") and b == [0.0] * 8
    assert df.select(embedding.dot(F.col("v"), F.col("v")).alias("d")).first().d == pytest.approx(1.0)


def plain_scores(rows, queries):
    """Every signal of every pair, one by one."""
    out = {}
    for q, ns, text in queries:
        own = [r for r in rows if r[1] == ns]
        bags = {r[0]: stemmed(r[3]) for r in own}
        n, mean = len(own), sum(map(len, bags.values())) / max(len(own), 1)
        asked, named, e = set(stemmed(text)), entities.text_names(text), embedding.HashEmbedding()
        for id_, _, source, content, importance, meta in own:
            bag, held = bags[id_], set(bags[id_])
            bm25 = 0.0
            for t in asked & held:
                df = sum(t in b for b in bags.values())
                tf = bag.count(t)
                bm25 += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(bag) / max(mean, 1)))
            near = [max([1.0 if a == b else 0.5 if min(len(a.encode()), len(b.encode())) >= 4 and (a.startswith(b) or b.startswith(a)) else 0.0 for b in held], default=0.0) for a in asked]
            entity = min(0.5 * len(named & set((meta.get("entities") or "").lower().split("\n")) - {""}), 1.2)
            turn = next((int(p) for p in reversed((source or "").split("_")) if p.isdigit()), None)
            score = 0.32 * (len(asked & held) / len(asked | held) if asked | held else 0) + 0.13 * bm25 + 0.15 * entity + 0.05 * (meta.get("speaker", "").lower() in text.lower() and meta.get("speaker", "") != "")
            score += 0.02 * max(embedding.cosine(e.embed(text), e.embed(content)), 0) + 0.03 * importance + 0.05 * {"verbatim_turn": 1.2, "verbatim_session": 0.3, "llm_fact": 1.1, "observation": 1.0}.get(meta.get("memory_kind"), 0.8)
            score += 0.25 * sum(near) / max(len(asked), 1) + (0.1 / (1 + turn) if entity > 0.05 and turn is not None else 0)
            out[q, id_] = (round(score, 6), source)
    return out


def test_search_equals_plain_scores(spark, monkeypatch):
    monkeypatch.setattr(search, "ROWS", 7)
    monkeypatch.setattr(search, "BLOCK_BYTES", 200)
    rnd = random.Random(8)
    words = ["walk", "walking", "walker", "river", "rivers", "Ann", "Bob", "tea", "teapot", "house", "É", "it's", "zebra"]
    rows = [(i, rnd.choice("ab"), rnd.choice([None, "s_1", "s_2", "t_x", "c_3_u"]), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 9))), rnd.random(), {"speaker": rnd.choice(["", "Ann"]), "memory_kind": rnd.choice(["verbatim_turn", "observation", "z"])}) for i in range(60)]
    rows = [(*r[:5], {**r[5], "entities": "\n".join(sorted(entities.text_names(r[3])))}) for r in rows]
    queries = [(f"q{i}", rnd.choice("abc"), " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 6)))) for i in range(12)]
    scores = plain_scores(rows, queries)
    want = set()
    for q, _, _ in queries:
        seen, kept = {}, []
        for (score, source), id_ in sorted(((s, i) for (k, i), s in scores.items() if k == q), key=lambda x: (-x[0][0], x[1])):
            seen[source] = seen.get(source, 0) + 1
            if source is None or seen[source] <= 2:
                kept.append((q, id_, score))
        want.update((q, i, s, k) for k, (q, i, s) in enumerate(kept[:5], 1))
    asked = spark.createDataFrame(queries, "query_id string, namespace string, text string")
    got = search.search(spark.createDataFrame(rows, MEMORY).repartition(3), asked, search.Search(limit=5)).withColumn("reasons", search.reasons()).collect()
    assert {(r.query_id, r.id, r.score, r.rank) for r in got} == want and all(r.reasons for r in got)
    assert search.search(spark.createDataFrame([], MEMORY), asked).count() == 0 and search.search(spark.createDataFrame(rows, MEMORY), asked.limit(0)).count() == 0


def test_numbers_of_terms_equal_stems():
    words = "dying lying skies 'cause y's cry cries crying Cry's ties hoping hopes hope happily happy généreux été is as 'a a's eing ing gently news x' toys generously arsenal Ünder".split()
    for some in (words, words[::3], ["die"], ["e"], []):
        vocabulary = {t: k for k, t in enumerate(sorted({t for w in some for t in stemmed(w)}))}
        numbers = TermNumbers(vocabulary, most=5)
        for w in words:
            got = stemmed(w)
            assert numbers.count(w) == (len(got), {vocabulary[t]: 1 for t in got if t in vocabulary}), w
    assert TermNumbers({"cri": 0}).count("cry Cries x cried") == (4, {0: 3}) and TermNumbers({}).count(None) == (0, {})


def test_bm25_alone_equals_the_signal_among_others(spark):
    rnd = random.Random(6)
    words = ["walk", "walking", "river", "Rivers", "tea", "cry", "cries", "dying", "die", "it's"]
    rows = [(i, "default", None, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12))), 0.5, {}) for i in range(40)]
    memories, asked = spark.createDataFrame(rows, MEMORY), spark.createDataFrame([(k, " ".join(rnd.sample(words, 3))) for k in range(5)], "query_id long, text string")
    one = {(r.query_id, r.id): r.score for r in search.search(memories, asked, search.Search(limit=50, weights=search.BM25_ONLY, per_source=None, matches_only=True)).collect()}
    all_ = {(r.query_id, r.id): round(r.bm25, 6) for r in search.search(memories, asked, search.Search(limit=50, per_source=None)).collect() if r.bm25 > 0}
    assert one == all_ and len(one) > 50


def test_external_embeddings_have_their_weights(spark):
    class Length:
        dimensions = 1

        def embed(self, text):
            return [float(len(text))]

    rows = [(1, "default", None, "aa", 0.0, {}), (2, "default", None, "bbbb", 0.0, {})]
    asked = spark.createDataFrame([(1, "zz")], "query_id long, text string")
    got = {r.id: r.score for r in search.search(spark.createDataFrame(rows, MEMORY), asked, search.Search(provider=Length())).collect()}
    assert got == {1: pytest.approx(0.25 * 4 + 0.12 * 0.8), 2: pytest.approx(0.25 * 8 + 0.12 * 0.8)}


def test_nearest_in_blocks(spark):
    rnd = random.Random(2)
    rows = [(i, [float(rnd.randint(-3, 3)) for _ in range(4)]) for i in range(100)]
    v = spark.createDataFrame([*rows, (100, None), (101, [1.0])], "id long, e array<double>")
    q = v.filter("id % 10 = 0").withColumnRenamed("id", "query_id")
    want = set()
    for k, e in rows[::10]:
        best = sorted(((-sum(a * b for a, b in zip(e, x)), i) for i, x in rows))[:6]
        want.update((k, i, -s) for s, i in best)
    for size in (32 << 20, 100):
        assert {(r.query_id, r.id, r.score) for r in search.nearest(v, q, 6, block_bytes=size, rows=9).collect()} == want


def test_an_embedding_server(spark):
    import http.server
    import json
    import threading

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            known = {"short": {"embedding": [1.0]}, "odd": {"x": 1}}.get(asked["prompt"], {"embedding": [float(len(asked["prompt"])), 1, 2, 3, 4, 5, 6, 7]})
            self.send_response(500 if asked["prompt"] == "broken" else 200)
            self.end_headers()
            self.wfile.write(json.dumps(known).encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/api/embeddings"
    one, strict = embedding.HttpEmbedding(url, "m", 8), embedding.HttpEmbedding(url, "m", 8, strict=True)
    assert one.embed("abc") == [3.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0] == strict.embed("xyz")
    for text in ("short", "odd", "broken"):
        assert one.embed(text) == embedding.HashEmbedding(8).embed(text)
        with pytest.raises((OSError, ValueError)):
            strict.embed(text)
    df = spark.createDataFrame([("abcd",), (None,)], "t string").select(embedding.embed_column(one)("t").alias("v"))
    assert [r.v[0] for r in df.collect()] == [4.0, 0.0]
    server.shutdown()
    server.server_close()
    assert one.embed("abc") == embedding.HashEmbedding(8).embed("abc")


def test_many_namespaces_are_searched_apart(spark, monkeypatch):
    """Only the queries of crowded namespaces are scored in blocks, against these namespaces; the hits are those of blocks."""
    rnd = random.Random(11)
    words = [f"word{i}" for i in range(40)] + ["Ann", "Bea", "Old Town"]
    rows = [(i, f"n{i % 30}" if i < 300 else "n3" if i < 330 else None, f"s_{i % 4}" if i % 5 else None, " ".join(rnd.choices(words, k=rnd.randrange(9))), 0.1 * (i % 9), {"speaker": "ann"} if i % 3 else None) for i in range(340)]
    stored = entities.enrich(spark.createDataFrame(rows, MEMORY))
    asked = spark.createDataFrame([(q, f"n{q % 32}" if q < 70 else None, " ".join(rnd.choices(words, k=4)) if q % 9 else None) for q in range(75)], "query_id long, namespace string, text string")
    blocks, plain = [], search.score_block
    monkeypatch.setattr(search, "score_block", lambda memories, queries, *more: blocks.extend(q.namespace for q in queries) or plain(memories, queries, *more))
    monkeypatch.setattr(search, "APART", 20)
    monkeypatch.setattr(search, "ROWS", 16)
    for plan in (search.Search(limit=3), search.Search(limit=4, weights=search.BM25_ONLY, per_source=None, matches_only=True)):
        blocks.clear()
        got = search.search(stored, asked, plan)
        assert set(blocks) == {"n3"}
        want = search._by_blocks(stored, asked, plan, None, lambda rows: rows)
        assert got.columns == want.columns
        keys = ("query_id", "id", "source", "rank")
        assert sorted((tuple(r[k] for k in keys) for r in got.collect()), key=repr) == sorted((tuple(r[k] for k in keys) for r in want.collect()), key=repr)
        assert got.select("query_id").distinct().count() > 50


def test_bm25_statistics_are_summed_before_they_are_shuffled(spark):
    import pyarrow as pa

    from recallforge.operators import retrieve

    rnd = random.Random(3)
    texts = [None, "", "...", "Ünser Hund's 'dog'", *(" ".join(rnd.choices(["dogs", "dog", "running", "été", "x1"], k=rnd.randrange(30))) for _ in range(300))]
    got = retrieve.bm25_stats(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string"))
    bags = [stemmed(t) for t in texts]
    want = {t: sum(t in b for b in bags) for b in bags for t in b}
    rows = got.collect()
    assert {r.term: r.df for r in rows} == want and {(r.doc_count, r.avg_len) for r in rows} == {(len(texts), sum(map(len, bags)) / len(texts))}
    # a run's terms come once, not once a text
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert [len(s) for s in retrieve.slices(pa.array(["a" * (3 << 20), "b" * (3 << 20), None, "c" * (9 << 20), *["d"] * 3000]))] == [1, 2, 1, 2048, 952]


def test_signals_equal_those_of_single_pairs(spark):
    """Scores of a batch are those that each text has by itself, and only what has a weight is computed (before, BM25 always was)."""
    words = "cries crying cried Crystal's cry the runner running run Été ab abcd abcdef x 2020".split()
    rnd = random.Random(5)
    texts = ["", *(" ".join(rnd.choices(words, k=rnd.randint(1, 30))) for _ in range(60))]
    queries = [search.Query(k, "ns", " ".join(rnd.choices(words, k=4))) for k in range(7)] + [search.Query(9, "ns", "")]
    batch = pd.DataFrame({"content": texts, "namespace": ["ns"] * len(texts), "entities": [[]] * len(texts), "turn": [1.0] * len(texts), "speaker": [""] * len(texts)})
    block = search.Block(queries, search.Search())
    df = Counter(block.terms[t] for text in texts for t in set(stemmed(text)) if t in block.terms)
    stats = {"ns": (len(texts), float(np.mean([len(stemmed(t)) for t in texts])), df)}
    got = search.signals(batch, block, stats)
    for i, text in enumerate(texts):
        bag = stemmed(text)
        for j, q in enumerate(queries):
            asked, shared = set(stemmed(q.text)), set(bag) & set(stemmed(q.text))
            idf = {t: np.log((len(texts) - df[block.terms[t]] + 0.5) / (df[block.terms[t]] + 0.5) + 1) for t in asked}
            bm25 = sum(idf[t] * bag.count(t) * 2.5 / (bag.count(t) + 1.5 * (0.25 + 0.75 * len(bag) / stats["ns"][1])) for t in shared)
            near = [t for t in asked - shared if len(t.encode()) >= 4 and any(len(b.encode()) >= 4 and (b.startswith(t) or t.startswith(b)) for b in bag)]
            cosine = max(float(np.dot(HashEmbedding().embed(text), HashEmbedding().embed(q.text))), 0.0)
            want = {"shared": len(shared), "bm25": bm25, "density": len(shared) / max(len(set(bag) | asked), 1), "prefix": (len(shared) + len(near) / 2) / max(len(asked), 1), "cosine": cosine}
            assert all(abs(got[s][i, j] - v) < 1e-9 for s, v in want.items()), (text, q.text)
    assert set(search.signals(batch, search.Block(queries, search.Search(weights={"cosine": 1.0})), stats)) == {"cosine"}


def test_long_texts_are_scored_a_few_at_once(monkeypatch):
    """Pieces of a batch are bounded by bytes of text too, not by rows alone; they hold all rows in order."""
    monkeypatch.setattr(search, "TEXT_BYTES", 100)
    batch = pa.RecordBatch.from_pydict({"id": list(range(700)), "content": ["x" * 90, None, "y" * 1000, *["z" * 30] * 97, *[""] * 600]})
    found = list(search.pieces(batch))
    assert [i for p in found for i in p.column("id").to_pylist()] == list(range(700))
    assert all(p.num_rows == 1 or pc.sum(pc.binary_length(p.column("content"))).as_py() <= 200 for p in found) and max(p.num_rows for p in found) <= search.ROWS
    assert list(search.pieces(batch.slice(0, 0))) == []


def test_evidence_is_searched_once_and_texts_stay_where_they_are(spark):
    """Hits are a written table before their texts are joined (before, the search was part of each plan that used its evidence)."""
    from recallforge.plans import memory

    plans = [f(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for f in (memory.item_evidence, memory.answer_spans)]
    assert plans[0].count("MapInArrow") == 0 and plans[1].count("MapInArrow scored") == 0 and "documents.parquet" not in plans[1], plans
