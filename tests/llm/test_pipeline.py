"""The pipeline's stages, each on what the one before it kept, and the whole against a plain reading of its definition."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from recallforge.llm import near_dups, secrets, toxicity

DIR = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontamination", "secret_scans", "mixing"]
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR).cache()
        if name != "mixing":
            assert out.columns == docs.columns and 0.5 * before < out.count() <= before
        else:
            assert out.columns == [*docs.columns, "replica", "mix_key"]
        docs, before = out, out.count()


def small_tables(spark, path, docs, labels, items):
    for name, rows, schema in (("documents", docs, DOC), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def made_documents():
    """Clean and toxic documents, copies, near copies, benchmark passages, secrets, and odd rows."""
    rnd = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bdfglm" for b in "aeiou" for c in ("ra", "ne", "sto")]
    rows, labels = [], []
    items = [(k, " ".join(rnd.choice(words) for _ in range(20))) for k in range(3)]
    for i in range(120):
        text = [rnd.choice(words) for _ in range(80)]
        if i % 3 == 0:
            text[10] = rnd.choice(["idiot", "moron"])
        if i % 20 == 1:
            text[20:40] = items[i % 3][1].split()
        if i % 10 == 2:
            text[5] = 'password="abcdefghijklmnop"'
        rows.append((i, " ".join(text), "en", f"s{i % 3}" if i % 7 else None, 1))
        labels.append((i, 1, int(i % 3 == 0)))
    near = rows[4][1].split()
    near[70] = "changed"
    rows += [(200, rows[4][1], "en", "s1", 1), (201, " ".join(near), "en", "s1", 1), (202, None, None, None, None), (203, "", "en", "s0", 0), (204, " \n", None, "s0", 2), (205, "one", "en", "s0", 3), (205, "one", "en", "s0", 3), (None, "no id at all here", "en", "s1", 9)]
    return rows, [*labels, (None, 1, 1), (202, None, None)], items


def plain_pipeline(rows, model, items):
    """(doc_id, text, replica) of the stages, read one by one."""
    scores = model.scores([r[1] for r in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s < 0.3]
    sets = [set(near_dups.shingles(r[1], 5).tolist()) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and rows[i][0] is not None and rows[j][0] is not None and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    rows = [r for i, r in enumerate(rows) if rows[root(i)][0] == r[0]]
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {tuple(w[i : i + min(13, len(w))]) for _, t in items for w in [word.findall(t.lower())] for i in range(len(w) - min(13, len(w)) + 1)}
    kept = []
    for r in rows:
        w = word.findall((r[1] or "").lower())
        hit = {p for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            kept.append(r)
    out = []
    for r in kept:
        text = r[1]
        if text:
            gone = [False] * len(text)
            for rule in secrets.RULES:
                for m in re.finditer(rule.pattern, text, rule.flags):
                    if len(m[rule.group]) >= rule.least:
                        gone[m.start() : m.end()] = [True] * (m.end() - m.start())
            text = re.sub("\0+", "<secret>", "".join("\0" if g else c for c, g in zip(text, gone, strict=True)))
        out.append((r[0], text, r[3]))
    n = Counter(s for _, _, s in out)
    mixed = []
    for id_, text, source in out:
        rate = len(out) * math.sqrt(n[source]) / sum(map(math.sqrt, n.values())) / n[source]
        u = int(hashlib.md5(f"mix:{'' if id_ is None else id_}".encode()).hexdigest()[:13], 16) / (1 << 52)
        count, term, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            count += 1
            term *= rate / count
            total += term
        mixed += [(id_, text, k) for k in range(1, count + 1)]
    return mixed


def test_whole_pipeline_equals_a_plain_reading(spark, tmp_path):
    rows, labels, items = made_documents()
    folder = small_tables(spark, tmp_path, rows, labels, items)
    read = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels")}
    model = toxicity.learn(read["documents"].select("doc_id", "text"), read["labels"], f"not ({toxicity.HELD_OUT})")
    got = corpus_pipeline.run(spark, folder).collect()
    want = plain_pipeline(rows, model, items)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2])
    assert sorted(((r.doc_id, r.text, r.replica) for r in got), key=key) == sorted(want, key=key)
    ids = {i for i, _, _ in want}
    assert not ids & {200, 201} and len([1 for i in range(0, 120, 3) if i in ids]) < 6 and not any("abcdefghijklmnop" in (t or "") for _, t, _ in want)


@pytest.mark.parametrize("with_docs", [True, False])
def test_pipeline_without_labels_or_rows(spark, tmp_path, with_docs):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, None, None, None, None), (2, "", "", "", 0), (3, "long " * 100_000, "en", "s", 5)] if with_docs else []
    got = corpus_pipeline.run(spark, small_tables(spark, tmp_path, rows, [], []))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "replica", "mix_key"] and (got.count() > 0) == with_docs
