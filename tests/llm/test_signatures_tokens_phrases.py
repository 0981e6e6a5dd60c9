"""Fingerprints, alignment of tokens, and phrases, against brute force and on edge cases."""

import collections
import hashlib
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from recallforge.llm import _common, alignment, collocations, simhash

rnd = random.Random(11)


def roots(keys, near):
    up = list(range(len(keys)))

    def root(x):
        return x if up[x] == x else root(up[x])

    for i in range(len(keys)):
        for j in range(i):
            if near(keys[i], keys[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(keys))]


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_are_those_of_the_definition(monkeypatch):
    texts = [" ".join(rnd.choice("abcdefgÄß") * rnd.randint(1, 3) for _ in range(rnd.randint(0, 40))) for _ in range(50)] + [None, "", " \n", "One", "one two\tTHREE", "x " * 5000]
    want = [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprints(texts).tolist() == want
    assert simhash.fingerprints(texts, block=7).tolist() == want  # a text's shingles in several blocks


@pytest.mark.parametrize(("small", "short"), [(4096, 32), (8, 3)])
def test_all_links_are_found_in_buckets_of_any_size(spark, monkeypatch, small, short):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "SHORT", short)
    base, prints = [rnd.getrandbits(64) for _ in range(4)], [rnd.getrandbits(64) for _ in range(60)]
    for b in base:  # large groups around a centre, whose members differ by up to 14 bits
        for _ in range(60):
            x = b
            for _ in range(rnd.randint(0, 7)):
                x ^= 1 << rnd.randrange(64)
            prints.append(x)
    prints = sorted(set(prints))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    found = {r.id: r.root for r in simhash.linked(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, _common.Scratch(spark, "t")).collect()}
    want, got = collections.defaultdict(set), collections.defaultdict(set)
    for p, s, r in zip(prints, signed, roots(prints, lambda a, b: (a ^ b).bit_count() <= 4), strict=True):
        want[r].add(p)
        got[found.get(s, s)].add(p)
    assert {*map(frozenset, want.values())} == {*map(frozenset, got.values())}


def test_one_wildcard_variants_meet_wherever_few_bits_differ():
    for _ in range(300):
        x = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4)))
        assert any(not x & mask for mask, _ in simhash.variants((1 << 64) - 1))
        assert not x & int(simhash.first_mask(np.array([x], np.uint64))[0])


def test_components_of_documents_and_edges(spark, edge_docs, no_docs):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[:i] + ["new"] * (i % 2) + words[i:])) for i in range(20)] + [(100, " ".join(rnd.choice(words) for _ in range(300))), (101, None), (102, " ")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    prints = [plain_fingerprint(t) for _, t in rows]
    want = roots(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    assert got == {d: (f"{p:016x}", rows[r][0]) for (d, _), p, r in zip(rows, prints, want, strict=True)}
    edge = simhash.simhash_components(edge_docs).collect()
    by = {r.doc_id: r for r in edge}
    assert len(edge) == 11 and by[2].component_id == 1 and by[7].component_id == 6 and by[5].component_id == 3 and by[3].fingerprint == "0" * 16 and by[None].component_id is None
    several = spark.createDataFrame([(1, words[0] * 3), (1, "other text of it"), (2, "other text of it"), (3, words[0] * 3)], "doc_id long, text string")
    assert {r.component_id for r in simhash.simhash_components(several).collect()} == {1}  # two texts of one id are one document
    assert simhash.simhash_components(no_docs).count() == 0


def plain_alignment(rows, a, b):
    alpha, corpus, per, best = alignment.byte_alphabet(), collections.Counter(), [], collections.Counter()
    for d, t in rows:
        s = (" " + (t or "")).encode()
        of_a, of_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [bytes(alpha[c] for c in a.id_to_token(i)) for i in of_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in of_b]
        if b"".join(bytes_a) != s or b"".join(bytes_b) != s:
            per.append((d, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([*map(len, bytes_a)]).tolist(), np.cumsum([*map(len, bytes_b)]).tolist()
        groups, i, j = [], 0, 0
        for e in sorted({*ends_a} & {*ends_b}):
            p, q = ends_a.index(e, i) + 1, ends_b.index(e, j) + 1
            groups.append((of_a[i:p], of_b[j:q]))
            i, j = p, q
        links = [(x, y) for x, f, e in zip(of_a, [0, *ends_a], ends_a, strict=False) for y, g, h in zip(of_b, [0, *ends_b], ends_b, strict=False) if f < h and g < e]
        corpus.update(links)
        per.append((d, of_a, of_b, groups, links))
    for (_, y), n in corpus.items():
        best[y] = max(best[y], n)
    shown = [";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g) for _, _, _, g, _ in per]
    return [(d, len(x), len(y), len(g), len(k), sum(corpus[p] == best[p[1]] for p in k), sum(corpus[p] for p in k), hashlib.sha256(s.encode()).hexdigest() if g else "") for (d, x, y, g, k), s in zip(per, shown, strict=True)]


def test_alignment_equals_plain_counting(spark, edge_docs, no_docs, monkeypatch):
    public, tokenizers, sp = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
    a_file, b_file = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
    a, b = tokenizers.Tokenizer.from_file(a_file), sp.SentencePieceProcessor(model_file=b_file)
    a.encode_special_tokens = True
    bits = ["the", "word", "ing", " ", " ", "  ", "\n", "\t", "\r\n", "\xa0", "é", "日本", "😀", "<s>", "<|endoftext|>", "　", "\x00", "\x1c", "'s", "123", "!!", " .", "\x7f", "}\r"]
    rows = [(i, "".join(rnd.choice(bits + ["▁"] * (i % 9 == 0)) for _ in range(rnd.randint(0, 25)))) for i in range(500)]
    rows += [(900, None), (901, ""), (None, "a b c"), (902, " "), (903, "\n"), (904, "a "), (905, " a \n "), (905, " a \n "), (906, "▁"), (907, "aaaaaaa " * 9)]
    monkeypatch.setattr(alignment, "SHARD_BYTES", 900)
    monkeypatch.setattr(alignment, "BATCH_BYTES", 200)
    monkeypatch.setattr(alignment, "FAN", 2)
    got = alignment.align(spark.createDataFrame(rows, "doc_id long, text string"), a_file, b_file).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_alignment(rows, a, b)))
    monkeypatch.undo()
    edge = [(r.doc_id, r.text) for r in edge_docs.collect() if r.doc_id != 8]
    got = alignment.align(edge_docs.filter("doc_id is null or doc_id <> 8"), a_file, b_file).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_alignment(edge, a, b)))
    long = alignment.align(edge_docs.filter("doc_id = 8"), a_file, b_file).first()
    assert long.n_a == len(a.encode(" " + "wörd " * 20000, add_special_tokens=False).ids) and long.n_b == len(b.encode("wörd " * 20000))
    assert alignment.align(no_docs, a_file, b_file).count() == 0


def test_units_are_tokenized_as_in_their_text():
    public = pytest.importorskip("public_tokenizers")
    pair = alignment.Pair(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
    assert pair.fast is not None and not pair.whole
    for _ in range(400):
        t = " " + "".join(chr(rnd.choice([32, 32, 10, 39, 97, 98, 115, 116, 101, 233, 0x17F, 46, 49, 9])) for _ in range(rnd.randint(1, 60)))
        assert pair.ids_a(t) == pair.a.encode(t, add_special_tokens=False).ids


def test_phrases_equal_sql(spark, edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_BYTES", 3000)
    vocabulary = [f"W{i}" for i in range(12)] + ["a.", "b,", "ü", "x\ty", "q\x0bq"]
    rows = [(rnd.choice(["en", "de", None, "und"]), " ".join(rnd.choice(vocabulary[: rnd.randint(2, 17)]) for _ in range(rnd.randint(0, 80)))) for _ in range(400)] + [("en", None), ("en", ""), ("fr", "once only"), ("en", ".,;\n")]
    docs = spark.createDataFrame(rows, "lang string, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    want = sorted(con.sql(collocations.ORACLE).fetchall())
    got = sorted(map(tuple, collocations.collocations(docs).collect()))
    assert len(want) > 100 and got == want
    few = sorted(map(tuple, collocations.collocations(docs, top=5).collect()))
    assert few == [r for r in want if r[1] <= 5]
    edge = [tuple(r) for r in collocations.collocations(edge_docs).collect()]
    con.register("documents", edge_docs.toPandas())
    assert sorted(edge) == sorted(con.sql(collocations.ORACLE).fetchall()) and edge
    assert collocations.collocations(no_docs).count() == 0


def test_an_automaton_has_all_phrases_of_a_shard():
    words, ids = collocations.numbered(["a b a b c. a B", "b a\tb", "", "c,,c"])
    automaton = collocations.BoundedAutomaton("en", words, ids)
    automaton.keep(np.ones(len(automaton.short()[0]), bool))
    every = np.ones(len(automaton.long()[0]), bool)
    got = {b" ".join(words[i] for i in p): n for _, of, counts in automaton.enumerated(every) for *p, n in zip(*(x.tolist() for x in of), counts.tolist(), strict=True)}
    assert got == {b"a": 4, b"b": 5, b"c": 3, b"a b": 4, b"b a": 2, b"b c": 1, b"a b a": 1, b"b a b": 2, b"a b c": 1}


def test_a_frequent_phrase_becomes_a_row_once(spark, monkeypatch):
    """However many shards have it; before, each shard gave a row for each phrase."""
    monkeypatch.setattr(collocations, "UNSUMMED", 3)
    schema = "part long, lang string, phrases binary, size long, counts binary"
    texts = ["a b c a b", "b", "a b c", "a b rare"]

    def made(batches):
        for _ in batches:
            for lang in ("en", "de", "en"):
                words, ids = collocations.numbered(texts)
                automaton = collocations.BoundedAutomaton(lang, words, ids)
                automaton.keep(np.ones(len(automaton.short()[0]), bool))
                yield collocations.phrase_chunks(lang, *automaton.phrases(np.ones(len(automaton.long()[0]), bool)), 4)

    got = sorted(map(tuple, collocations.summed(spark.range(20, numPartitions=20).mapInArrow(made, schema), 100).collect()))
    once = {"a": 4, "b": 5, "c": 2, "rare": 1, "a b": 4, "b c": 2, "c a": 1, "b rare": 1, "a b c": 2, "b c a": 1, "c a b": 1, "a b rare": 1}
    want = [(lang, p.count(" ") + 1, p, n * m) for lang, m in (("en", 40), ("de", 20)) for p, n in once.items() if n * m >= 100]
    assert got == sorted(want)
    assert collocations.phrase_chunks("en", pa.array([], pa.string()), np.empty(0, np.uint64), np.empty(0, np.int64), 4).num_rows == 0
