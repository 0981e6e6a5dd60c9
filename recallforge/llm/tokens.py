"""Op 5, token counts: a BPE vocabulary compiled to a deterministic transducer whose transitions carry token counts.

For every prefix of a unit there is exactly one last token of its BPE encoding: the suffix ``t`` for which the pair
(last token of what precedes ``t``, ``t``) is itself encoded as those two tokens.  Only places from which
what follows is the beginning of some piece can matter later; the last tokens at those places and their relative
counts are the states of a finite transducer.  Reading a character emits the change of the token count.  States are made when first reached
and kept up to a bound; past it the table is begun anew, which costs time only.

No piece holds a space after another character, so a space after a non-space resets the transducer whatever its
state.  A long text is cut into chunks; each chunk's map from incoming to outgoing state is (what precedes its first
reset, a constant count, what follows its last reset).  Those maps compose associatively and are folded pairwise, as
in a parallel prefix scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import documents, slices

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class _Memo(dict):
    """Counts of short units that were seen; cleared when full, so its memory is bounded."""

    def __init__(self, count, lead: str, most: int = 400_000):
        super().__init__()
        self.count, self.lead, self.most = count, lead, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self.count(self.lead + word) if self.lead or word else 0
        if len(word) <= 64:
            self[word] = n
        return n


class TokenTransducer:
    """Counts the tokens of a sentencepiece BPE model with byte fallback and an identity normalizer."""

    def __init__(self, model_file: str, max_states: int = 250_000, chunk: int = 1 << 15):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score = {sp.id_to_piece(i).replace("▁", " "): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        if sp.normalize("a  ﬁ\n") != "▁a▁▁ﬁ\n" or any(" " in p.lstrip(" ") for p in self.score):
            raise ValueError("only models with identity normalization, a leading space and spaces at the start of pieces")
        chars = {c for p in self.score for c in p}
        self.depth, self.max_states, self.chunk = max(map(len, self.score)), max_states, chunk
        self.begins = {p[:n] for p in self.score for n in range(1, len(p))}
        self.line_ends = "\n" not in chars  # then a line end is a token (or bytes) of its own
        self.spaced, self.bare = _Memo(self.run, " "), _Memo(self.run, "")
        self.pairs: dict[tuple[str, str], bool] = {}
        self.places: dict[tuple[str, str], tuple[list, list, str]] = {}
        self._reset()

    # -- the transducer ---------------------------------------------------------------------------------------------
    def _reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.of: list[tuple] = []
        self.next: list[dict[str, tuple[int, int]]] = []
        self.start = self._state(("", (None,), (0,)))

    def _state(self, key: tuple) -> int:
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = len(self.of)
            self.of.append(key)
            self.next.append({})
        return found

    def _merge(self, text: str) -> list[str]:
        """BPE by best score, leftmost first; for the few characters of two pieces."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, left: str | None, right: str) -> bool:
        key = (left or "", right)
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) > 300_000:
                self.pairs.clear()
            found = self.pairs[key] = self._merge(key[0] + right) == ([left, right] if left else [right])
        return found

    def _places(self, tail: str, c: str) -> tuple[list, list, str]:
        """What ``c`` does after ``tail``, the longest end that begins a piece: pieces that may end here (with the
        place they begin at, counted among the live places), the places that stay live, and the new tail."""
        text = tail + c
        live = [m for m in range(len(tail), -1, -1) if m == 0 or tail[-m:] in self.begins]
        at = {m: k for k, m in enumerate(live)}
        ends = [(at[n - 1], t, 1 if t in self.score else len(t.encode("utf-8", "surrogatepass"))) for n in range(1, len(text) + 1) if (t := text[-n:]) in self.score or n == 1]
        stay = [m for m in range(len(text), 0, -1) if text[-m:] in self.begins]
        return ends, [at[m - 1] for m in stay], text[len(text) - stay[0] :] if stay else ""

    def _step(self, state: int, c: str) -> tuple[int, int]:
        tail, last, counts = self.of[state]
        found = self.places.get((tail, c))
        if found is None:
            if len(self.places) > 100_000:
                self.places.clear()
            found = self.places[tail, c] = self._places(tail, c)
        ends, stay, new_tail = found
        for k, t, weight in ends:
            if self._fits(last[k], t):
                total = counts[k] + weight
                break
        else:
            raise AssertionError("no last token")
        key = (new_tail, (*[last[k] for k in stay], t), (*[counts[k] - total for k in stay], 0))
        return self._state(key), total - counts[-1]

    def run(self, unit: str) -> int:
        """Tokens of one unit, read from the start state."""
        if len(self.of) > self.max_states:
            self._reset()
        state, total = self.start, 0
        for i, c in enumerate(unit):
            step = self.next[state].get(c)
            if step is None:
                if i % 1024 == 1023 and len(self.of) > self.max_states:
                    key = self.of[state]
                    self._reset()
                    state = self._state(key)
                step = self.next[state][c] = self._step(state, c)
            state = step[0]
            total += step[1]
        return total

    # -- texts ------------------------------------------------------------------------------------------------------
    def _lines(self, s: str) -> int:
        """Tokens of ``s``, whose first word has no space before it unless ``s`` begins with one."""
        total = 0
        for i, line in enumerate(s.split("\n") if self.line_ends else [s]):
            if i:
                total += 1
            if "  " in line or line[-1:] == " ":
                total += sum(map(self.bare.__getitem__, re.findall(" *[^ ]+| +", line)))
            else:
                words = line.split(" ")
                total += self.bare[words[0]] + sum(map(self.spaced.__getitem__, words[1:]))
        return total

    def chunk_map(self, s: str) -> tuple[str, int | None, str]:
        """A chunk's state map: (before the first reset, count between the resets, from the last reset on)."""
        first = re.search("(?<=[^ ]) ", s)
        if not first:
            return s, None, ""
        last = len(s)
        while True:  # the last space that follows another character; found from the end, so in the time of one unit
            last = s.rfind(" ", 0, last)
            if last > 0 and s[last - 1] != " ":
                break
        return s[: first.start()], self._lines(s[first.start() : last]) if last > first.start() else 0, s[last:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two neighbouring chunks; associative."""
        (ah, an, at), (bh, bn, bt) = a, b
        left = ah if an is None else at
        cut = bool(left) and left[-1] != " " and bh[:1] == " "
        if an is None and bn is None:
            return (ah, 0, bh) if cut else (ah + bh, None, "")
        if an is None:
            return (ah, self._lines(bh) + bn, bt) if cut else (ah + bh, bn, bt)
        if bn is None:
            return (ah, an + self._lines(at), bh) if cut else (ah, an, at + bh)
        return ah, an + bn + (self._lines(at) + self._lines(bh) if cut else self._lines(at + bh)), bt

    def count(self, text: str | None) -> int:
        """Tokens of a whole text, as the library's ``encode`` gives them."""
        if not text:
            return 0
        s = " " + text.replace("▁", " ")
        if len(s) <= self.chunk:
            return self._lines(s)
        maps = [self.chunk_map(s[i : i + self.chunk]) for i in range(0, len(s), self.chunk)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        head, n, tail = maps[0]
        return self._lines(head) + (n or 0) + self._lines(tail)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every text; a map without a shuffle.

    Null and empty texts have 0 bytes and 0 tokens.  Repeated rows are counted each; other columns, whatever their
    names, are not read.  ``model_file`` must be readable on every executor (it comes with the installed package).
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = TokenTransducer(model_file)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text").to_pylist()
                sizes = [len(t.encode()) if t else 0 for t in texts]
                counts = [fst.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{text_col}` text").mapInArrow(counted, SCHEMA)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents; null and empty texts have none, very long ones are counted whole, repeated rows each."""
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))
