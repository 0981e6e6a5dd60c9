"""Op 11, cross-tokenizer alignment: cut texts where the tokens of two tokenizers end at the same byte.

The texts of a batch are concatenated.  A map from bytes to ends of tokens is made once for either tokenizer
(``bincount``); the places where both end cut the whole batch into groups, and every place where one ends closes one
link, a pair of tokens whose bytes overlap.  Prefix sums of these maps number tokens, groups and links, and their values
at the documents' bounds give each document's own.

Units (from a white space after another character to the next one) are tokenized once a task, since in neither
vocabulary does a token go across such a place; their tokens are spread over the batch by index.

How often a pair is linked in the corpus is needed at each of a document's links.  A shard (some 16 MB of texts) is
written as one row: the documents' figures, the shard's distinct pairs with counts, and each document's pairs as numbers
into those.  Only distinct pairs of a shard are shuffled, packed by ranges of B's tokens; a range is bounded by the
vocabularies.  They are summed over the corpus, and the sums go back to their shard.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, documents, mix, slices

#: Bytes of text in a shard, in what is aligned at once, and in what is tokenized at once; units kept between batches.
SHARD_BYTES, BATCH_BYTES, BLOCK_BYTES, UNITS = 16 << 20, 2 << 20, 1 << 16, 400_000
#: Bits of a token's id; ranges of pairs that are summed in one place; shards whose counts are added up at once.
ID_BITS, RANGES, FAN = 20, 512, 256
#: How A's units are split further; this is part of the format of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space at which units begin, in one byte each, and bytes after which it may.
_BREAK = np.zeros(256, bool)
_BREAK[[9, 10, 32]] = True
_PLAIN = np.ones(256, bool)
_PLAIN[:33] = False
_PLAIN[127] = False
#: White space of more bytes: a text with any is one unit.  Characters whose classes may differ between libraries.
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_RARE = re.compile("[^\x00-\u024f]")
_LEAD = " a"


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable bytes themselves, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Pair:
    """Two tokenizers, with the bytes of their tokens: A byte-level BPE from a .json, B by pieces from a .model."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        model = json.loads(self.a.to_str())
        splits = model["pre_tokenizer"] or {}
        if model["normalizer"] is not None or splits.get("type") != "ByteLevel" or splits.get("add_prefix_space"):
            raise ValueError("A has to be a byte-level tokenizer without a normalizer or an added space")
        chars = byte_alphabet()
        special = {t["id"] for t in model["added_tokens"]}
        names = {i: t for t, i in self.a.get_vocab().items()}
        self.a_bytes = [names[i].encode() if i in special else bytes(map(chars.__getitem__, names[i])) for i in range(self.a.get_vocab_size())]
        # where ids follow the order of the merges, a faster reader of ranks gives the same tokens
        vocab, merges = model["model"]["vocab"], (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        made = [vocab[x + y] for x, y in merges]
        self.fast = None
        if splits.get("use_regex", True) and made == sorted(set(made)) and not model["model"].get("ignore_merges"):
            self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(self.a_bytes) if i not in special}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        plain = [p.replace("▁", " ") for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        # else a piece could go across the beginning of a unit
        self.whole = self.b.normalize("a  ﬁ\n") != "▁a▁▁ﬁ\n" or any(" " in p.lstrip(" ") or set("\t\n") & set(p) for p in plain)
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << ID_BITS:
            raise ValueError(f"vocabularies of over {1 << ID_BITS} tokens")

        self.written = [f"{i}{m}" for i in range(max(len(self.a_bytes), len(self.b_bytes))) for m in ",|; "]

    @staticmethod
    def code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """One number for a pair of tokens: its range, by B's token, then B's, then A's."""
        part = (mix(b.astype(np.uint64)) % np.uint64(RANGES)).astype(np.int64)
        return part << 2 * ID_BITS | b << ID_BITS | a

    def ids_a(self, text: str) -> list[int]:
        if self.fast and not _RARE.search(text):
            return self.fast.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def ids_b(self, text: str) -> list[int]:
        """Tokens of a text that begins with a space: the one that B adds."""
        return self.b.encode(text[1:], num_threads=1)


class Units:
    """Tokens of the distinct units seen so far, as flat arrays; begun anew when there are too many."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.good: list[np.ndarray] = [np.empty(0, bool)]
        self.flat: tuple[list[np.ndarray], list[np.ndarray]] = ([np.empty(0, np.int64)], [np.empty(0, np.int64)])
        self.size: tuple[list[np.ndarray], list[np.ndarray]] = ([np.empty(0, np.int64)], [np.empty(0, np.int64)])

    def numbers(self, units: list[bytes]) -> np.ndarray:
        """A number for each of the distinct ``units``; their tokens are in ``arrays``."""
        if len(self.at) + len(units) > UNITS:
            self.clear()
        new = [u for u in units if u not in self.at]
        # units that end in a plain character can stand before others: many are tokenized at once
        joined = {True: [], False: [], None: []}
        for u in new:
            t = u.decode()
            joined[None if not _PLAIN[u[-1]] or _WIDE.search(t) or self.pair.whole else bool(_RARE.search(t))].append(u)
        for kind, of in joined.items():
            a = 0
            while a < len(of):
                b, size = a, 0
                while b < len(of) and (b == a or kind is not None and size < BLOCK_BYTES):
                    size += len(of[b])
                    b += 1
                self.tokenize(of[a:b])
                a = b
        return np.array([self.at[u] for u in units], np.int64)

    def tokenize(self, units: list[bytes]) -> None:
        """Tokens of units, as if they were one text; each on its own where they don't join to its bytes."""
        whole = b"".join(units)
        text = whole.decode()
        # B adds a space: a text that begins with another white space stands after a word that is left out again
        lead = 0 if text[:1] == " " else len(self.pair.ids_b(_LEAD))
        ids = self.pair.ids_a(text), self.pair.ids_b(text if not lead else _LEAD + text)[lead:]
        good = all(b"".join(map(names.__getitem__, x)) == whole for names, x in zip((self.pair.a_bytes, self.pair.b_bytes), ids, strict=True))
        if not good and len(units) > 1:
            for u in units:
                self.tokenize([u])
            return
        bounds = np.cumsum([len(u) for u in units])
        for side, sizes in ((0, self.pair.a_size), (1, self.pair.b_size)):
            flat = np.array(ids[side] if good else [], np.int64)
            self.flat[side].append(flat)
            self.size[side].append(np.diff(np.searchsorted(np.cumsum(sizes[flat]), bounds, "right"), prepend=0))
        self.good.append(np.full(len(units), good))
        for u in units:
            self.at[u] = len(self.at)

    def arrays(self, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, first token, number of tokens) by unit."""
        for held in (self.flat[side], self.size[side]):
            held[:] = [np.concatenate(held)]
        size = self.size[side][0]
        return self.flat[side][0], np.cumsum(size) - size, size

    def whole(self) -> np.ndarray:
        self.good[:] = [np.concatenate(self.good)]
        return self.good[0]


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``first[i], first[i] + 1, ...`` of ``size[i]`` numbers, one after another."""
    total = int(size.sum())
    shift = first - (np.cumsum(size) - size)
    return np.repeat(shift, size) + np.arange(total)


def cut_units(data: np.ndarray, bounds: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Where units begin in the bytes of documents; ``bounds`` are the documents' (the last is the end)."""
    space = _BREAK[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = space[1:] & _PLAIN[data[:-1]]
    # what has only white space up to its document's end is no unit of its own
    other = np.maximum.accumulate(np.where(space, -1, np.arange(len(data))))
    tail = other[bounds[1:] - 1]
    for d in np.flatnonzero((tail < bounds[1:] - 1) | single):
        begins[(bounds[d] if single[d] else tail[d] + 1) : bounds[d + 1]] = False
    begins[bounds[:-1]] = True
    return np.flatnonzero(begins)


def aligned(texts: list[str], pair: Pair, units: Units) -> tuple[dict[str, np.ndarray | list[str]], np.ndarray, np.ndarray]:
    """Figures of each of some texts, none empty, and their links: (of text, code of the pair) by text.

    The figures are n_a, n_b, n_groups, n_links and groups (a digest of their tokens).
    """
    held = [b" " + t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, held)])
    data = np.frombuffer(b"".join(held), np.uint8)
    single = np.array([pair.whole or bool(_WIDE.search(t)) for t in texts])
    starts = cut_units(data, bounds, single)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[starts, len(data)].astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
    unit = units.numbers(words.dictionary.to_pylist())[words.indices.to_numpy()]
    in_text = np.searchsorted(bounds, starts, "right") - 1
    good = np.ones(len(texts), bool)
    np.logical_and.at(good, in_text, units.whole()[unit])
    unit, in_text = unit[good[in_text]], in_text[good[in_text]]
    length = np.where(good, np.diff(bounds), 0)
    edge = np.r_[0, np.cumsum(length)]  # of texts, over the bytes of those that both tokenizers keep
    total, ids, number = int(edge[-1]), [], []
    for side, size_of in ((0, pair.a_size), (1, pair.b_size)):
        flat, first, size = units.arrays(side)
        ids.append(flat[ranges(first[unit], size[unit])])
        ends = np.cumsum(size_of[ids[side]])
        number.append(np.bincount(ends, minlength=total + 1) if total else np.zeros(1, np.int64))
    (ids_a, ids_b), (ends_a, ends_b) = ids, number
    before_a, before_b = np.cumsum(ends_a), np.cumsum(ends_b)  # tokens that end at or before each byte
    links_at = np.flatnonzero(ends_a | ends_b)
    cuts = np.cumsum(ends_a & ends_b)
    per = {"n_a": np.diff(before_a[edge]), "n_b": np.diff(before_b[edge]), "n_groups": np.diff(cuts[edge])}
    # the link that an end closes is of the tokens there: those of which one ends here, or a later one
    link_a, link_b = ids_a[before_a[links_at] - ends_a[links_at]], ids_b[before_b[links_at] - ends_b[links_at]]
    per["n_links"] = np.diff(np.searchsorted(links_at, edge, "right"))
    # tokens in the order of groups, A's before B's, each with the mark that follows it
    of_a, of_b = (np.r_[0, cuts][np.flatnonzero(e)] for e in (ends_a, ends_b))
    groups = int(cuts[-1])
    in_a, in_b = np.cumsum(np.bincount(of_a, minlength=groups)), np.cumsum(np.bincount(of_b, minlength=groups))
    place_a = np.arange(len(ids_a)) + np.r_[0, in_b][of_a]
    place_b = np.arange(len(ids_b)) + in_a[of_b] if groups else np.empty(0, np.int64)
    shown = np.empty(len(ids_a) + len(ids_b), np.int64)
    shown[place_a], shown[place_b] = 4 * ids_a, 4 * ids_b
    shown[place_a[in_a - 1]] += 1
    shown[place_b[in_b - 1]] += 2
    size = per["n_a"] + per["n_b"]
    last = np.cumsum(size)
    written = list(map(pair.written.__getitem__, shown.tolist()))
    per["groups"] = [hashlib.sha256("".join(written[e - n : e])[:-1].encode()).hexdigest() if n else "" for e, n in zip(last.tolist(), size.tolist(), strict=True)]
    return per, np.repeat(np.arange(len(texts)), per["n_links"]), pair.code(link_a, link_b)


FIGURES = ("n_a", "n_b", "n_groups", "n_links")
_CHUNK = pa.struct([("part", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())])
_SHARD = "shard string, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups array<string>, held array<long>, links binary, chunks array<struct<part:int,pairs:binary,counts:binary>>"
_NAMES = [c.split()[0] for c in _SHARD.split(", ")]


def packed(values: np.ndarray) -> bytes:
    """Integers of 64 bits, by the planes of their bytes, compressed."""
    planes = values.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    planes = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def shard_row(parts: list[tuple[list, dict, np.ndarray, np.ndarray]]) -> list[list]:
    """A shard as the columns of one row.  Links of a document are its distinct pairs, by differences, and their numbers."""
    ids = [d for p in parts for d in p[0]]
    base = np.cumsum([0, *(len(p[0]) for p in parts)])
    doc = np.concatenate([p[2] + b for p, b in zip(parts, base[:-1], strict=True)])
    codes, pairs = pd.factorize(np.concatenate([p[3] for p in parts]))
    order = np.argsort(pairs)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    pairs, many = pairs[order], max(1, len(pairs))
    each = np.sort(doc * many + rank[codes])
    first = np.flatnonzero(np.r_[True, each[1:] != each[:-1]]) if len(each) else np.empty(0, np.int64)
    each, times = each[first], np.diff(np.r_[first, len(each)])
    doc, at = each // many, each % many
    held = np.bincount(doc, minlength=len(ids))
    step = np.diff(at, prepend=0)
    begins = (np.cumsum(held) - held)[held > 0]
    step[begins] = at[begins]
    figures = [np.concatenate([p[1][c] for p in parts]).tolist() for c in FIGURES]
    counts = np.bincount(at, weights=times, minlength=len(pairs)).astype(np.int64)
    part = pairs >> 2 * ID_BITS
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.empty(0, np.int64)
    chunks = [{"part": int(part[a]), "pairs": packed(np.diff(pairs[a:b], prepend=0)), "counts": packed(counts[a:b])} for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(pairs)], strict=True)]
    return [[uuid.uuid4().hex], [ids], *([f] for f in figures), [[g for p in parts for g in p[1]["groups"]]], [held.tolist()], [packed(np.r_[step, times])], [chunks]]


def shards(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Rows of shards of the texts of docs (doc_id, text)."""
    longs = pa.list_(pa.int64())
    types = [pa.string(), longs, longs, longs, longs, longs, pa.list_(pa.string()), longs, pa.binary(), pa.list_(_CHUNK)]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(a_file, b_file)
        units, parts, size = Units(pair), [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(shard_row(parts), types, strict=True)], names=_NAMES)

        for whole in batches:
            for batch in slices(whole, "text", BATCH_BYTES):
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                some = [i for i, t in enumerate(texts) if t]
                every: dict = {c: np.zeros(len(ids), np.int64) for c in FIGURES} | {"groups": [""] * len(ids)}
                doc = pairs = np.empty(0, np.int64)
                if some:
                    per, doc, pairs = aligned([texts[i] for i in some], pair, units)
                    doc = np.array(some, np.int64)[doc]
                    for c in FIGURES:
                        every[c][some] = per[c]
                    for i, g in zip(some, per["groups"], strict=True):
                        every["groups"][i] = g
                parts.append((ids, every, doc, pairs))
                size += sum(len(texts[i]) for i in some)
                if size >= SHARD_BYTES:
                    yield row()
                    parts, size = [], 0
        if parts:
            yield row()

    return docs.mapInArrow(made, _SHARD)


def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of several, sorted, with their counts added up."""
    pairs, counts = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.argsort(pairs, kind="stable")
    pairs = pairs[order]
    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
    return pairs[first], np.add.reduceat(counts[order], first)


def sums(chunks: DataFrame, *by: str) -> DataFrame:
    """(part, pairs, counts): counts added up by ``by``; of a range no more than its pairs are held, a bounded number."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, rows = None, [], 0

        def row() -> pa.RecordBatch:
            pairs, counts = added(held)
            out = [pa.array([key[0]], pa.int32()), pa.array([packed(np.diff(pairs, prepend=0))]), pa.array([packed(counts)])]
            return pa.RecordBatch.from_arrays(out, names=["part", "pairs", "counts"])

        for batch in batches:
            for *k, pairs, counts in zip(*(batch.column(c).to_pylist() for c in (*by, "pairs", "counts")), strict=True):
                if k != key:
                    if held:
                        yield row()
                    key, held, rows = k, [], 0
                held.append((np.cumsum(unpacked(pairs)), unpacked(counts)))
                rows += len(held[-1][0])
                if rows > 1 << 20:
                    held = [added(held)]
                    rows = 0
        if held:
            yield row()

    dealt = chunks.select(*by, "pairs", "counts").repartition(*by).sortWithinPartitions(*by)
    return dealt.mapInArrow(stream, "part int, pairs binary, counts binary")


def looked_up(chunks: DataFrame, totals: DataFrame, turns: int) -> DataFrame:
    """(shard, part, sums): for each pair of a shard's chunk, in its order, twice the pair's total, plus one if it is B's best."""
    asked = chunks.selectExpr("part", "turn", "shard", "pairs", "cast(null as binary) counts")
    given = totals.select("part", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), F.lit("").alias("shard"), "pairs", "counts")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = value = None
        for batch in batches:
            out: list[tuple] = []
            for part, shard, pairs, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "pairs", "counts")), strict=True):
                pairs = np.cumsum(unpacked(pairs))
                if counts is None:
                    out.append((shard, part, packed(value[np.searchsorted(known, pairs)])))
                    continue
                known, total = pairs, unpacked(counts)
                first = np.flatnonzero(np.r_[True, np.diff(pairs >> ID_BITS) != 0])
                most = np.repeat(np.maximum.reduceat(total, first), np.diff(np.r_[first, len(pairs)]))
                value = 2 * total + (total == most)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 3, (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["shard", "part", "sums"])

    # a range's totals come before the chunks that ask for them
    rows = asked.unionByName(given).repartition("part", "turn").sortWithinPartitions("part", "turn", "shard")
    return rows.mapInArrow(stream, "shard string, part int, sums binary")


def align(docs: DataFrame, a_file: str, b_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of ``docs``.

    A reads a space and the text, B the text, to which it adds the space; texts that are null or empty, or whose tokens
    don't join to those bytes again (as B's where a text holds U+2581), have no tokens: zeros, and an empty digest.
    ``n_best`` are links whose pair is linked as often in the corpus as any pair of its B token, ``count_sum`` sums how
    often the pairs of the links are linked.  Repeated rows and rows with a null id count like others; other columns are
    not read.  The files must be readable on every executor.
    """
    scratch = Scratch(docs.sparkSession, "align")
    made = scratch.table(shards(docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text"), a_file, b_file), "shards")
    turns = -(-made.count() // FAN) or 1
    chunks = made.selectExpr("shard", f"cast(pmod(xxhash64(shard), {turns}) as int) turn", "inline(chunks)")
    totals = scratch.table(sums(sums(chunks, "part", "turn"), "part"), "totals")
    back = looked_up(chunks, totals, turns).groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("part", "sums"))).alias("sums"))

    def figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                flat = {c: row.column(c).flatten() for c in ("doc_id", *FIGURES, "groups", "held")}
                v = np.concatenate([np.empty(0, np.int64), *(unpacked(x["sums"]) for x in row.column("sums")[0].as_py() or ())])
                held, links = flat["held"].to_numpy(), unpacked(row.column("links")[0].as_py())
                step, times = links[: len(links) // 2], links[len(links) // 2 :]
                # pairs' numbers are running sums of the steps within a document
                run, first = np.r_[0, np.cumsum(step)], np.cumsum(held) - held
                at = run[1:] - np.repeat(run[first], held)
                out = []
                for x in (times * (v[at] & 1), times * (v[at] >> 1)):
                    to = np.r_[0, np.cumsum(x)]
                    out.append(pa.array(to[first + held] - to[first], pa.int64()))
                yield pa.RecordBatch.from_arrays([flat["doc_id"], *(flat[c] for c in FIGURES), *out, flat["groups"]], names=["doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = scratch.lasting(made.drop("chunks").join(back, "shard", "left").mapInArrow(figures, schema), "out")
    scratch.drop()
    return out


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of all documents; null, empty and very long texts, and repeated rows, as in ``align``."""
    import public_tokenizers

    return align(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
