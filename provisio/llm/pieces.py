"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

The lattice of a text has an edge for every vocabulary piece that its characters spell, and byte pieces
for characters that no piece spells. A piece's weight is p(rank) proportional to 1 / (rank + SHIFT) to the
power SHARPNESS, from the order of the public model's pieces. Forward filtering sums the weights of all
paths to each node; backward sampling then draws pieces from the end with the exact posterior, so a text's
segmentation s has probability weight(s) / sum of all weights.

No piece crosses a newline or goes from a non-space to a space, so the lattice falls apart into chunks
there; a batch filters each distinct chunk once, in numpy, and draws all its occurrences at once. Uniforms
come from a counter-based hash of (seed, row key, chunk number, step): the same row gives the same pieces
in any batch, partition or retry. Texts are never cut short; memory is bounded by a slice of characters,
and by one text's own size beyond that.

The vocabulary is read where the driver runs and sent to the tasks, so executors need no file of it.

Defined results: null text gives null pieces and decodes to null; the empty text gives no pieces.
Row keys that repeat repeat their draws; a null key counts as 0. An empty table gives an empty result. Only the key
and the text are read; the stage replaces columns pieces and decoded_ok where they are there.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provisio.llm.common import Sent, bounded_batches, table

SEED = 42
SHIFT = 8.0
SHARPNESS = 1.0
SLICE_CHARS = 250_000
LONG = 64  # longer chunks are filtered in the log domain, one by one
SCALE = 300.0  # per character; keeps path sums of LONG characters inside doubles
CHUNKS = re.compile(r"\n| *[^ \n]+| +")
MASK = (1 << 64) - 1
KEPT_EDGES = 1_000_000  # of filtered chunks, 16 bytes each, before they are forgotten


def parted(text: str) -> list[str]:
    """The chunks of text with the leading space that decoding drops."""
    text = " " + text
    if "  " in text or "\x1f" in text or " \n" in text:
        return CHUNKS.findall(text)
    return [c for c in text.replace(" ", "\x1f ").replace("\n", "\x1f\n\x1f").split("\x1f") if c]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Lattice:
    """A vocabulary as a trie in arrays. surfaces[id] are the bytes that a piece stands for."""

    def __init__(self, pieces: list[tuple[int, str]], bytes_from: int, size: int):
        self.surfaces = np.empty(size, object)
        self.surfaces[:] = b""
        for b in range(256):
            self.surfaces[bytes_from + b] = bytes([b])
        self.bytes_from = bytes_from
        rank = np.arange(size, dtype=np.float64)
        weight = (rank + SHIFT) ** -SHARPNESS
        self.logp = np.log(weight / weight.sum())
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for k, text in pieces:
            self.surfaces[k] = text.encode()
            at = 0
            for c in map(ord, text):
                nxt = nodes.get((at, c))
                if nxt is None:
                    nxt = nodes[at, c] = len(ends)
                    ends.append(-1)
                at = nxt
            ends[at] = k
        self._hash(np.array([(a << 21) + c for a, c in nodes], np.int64), np.array(list(nodes.values()), np.int64))
        self.ends = np.array(ends, np.int64)
        self.pieces = dict((t, k) for k, t in pieces)
        self.deepest = max((len(t) for t in self.pieces), default=1)
        length = np.zeros(size)
        for t, k in self.pieces.items():
            length[k] = len(t)
        self.weight = np.exp(self.logp + length * math.log(SCALE))
        self.bare = np.array([0.0, *(math.exp(k * self.logp[-1] + math.log(SCALE)) for k in range(1, 5))])
        self.forget()

    def _hash(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Trie edges in an open-addressed table, so that a step costs a multiplication and a look."""
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.slots, self.next, todo = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64), np.arange(len(keys))
        slot = self._slot(keys)
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            first = free[np.unique(slot[free], return_index=True)[1]]
            self.slots[slot[first]], self.next[slot[first]] = keys[first], values[first]
            todo = np.setdiff1d(todo, first, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The trie node after char, or -1."""
        key = (state << 21) + char
        slot = self._slot(key)
        there = self.slots[slot]
        out = np.where(there == key, self.next[slot], -1)
        left = np.flatnonzero((there != key) & (there >= 0))
        at = slot[left]
        while len(left):
            at = (at + 1) & ((1 << self.bits) - 1)
            there = self.slots[at]
            hit = there == key[left]
            out[left[hit]] = self.next[at[hit]]
            rest = ~hit & (there >= 0)
            left, at = left[rest], at[rest]
        return out

    def forget(self) -> None:
        """Chunks that were filtered before, as they come: node numbers, and edges sorted by (end node, length)."""
        self.known: dict[str, int] = {}
        self.base, self.final, self.first = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.start, self.piece, self.cum = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int64)
        self.nodes = 0

    @classmethod
    def load(cls, model: str | bytes) -> Lattice:
        """From a model file or its bytes."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model if isinstance(model, bytes) else Path(model).read_bytes())
        size = sp.get_piece_size()
        kinds = [(k, sp.id_to_piece(k)) for k in range(size) if not (sp.is_byte(k) or sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k))]
        return cls([(k, t.replace("▁", " ")) for k, t in kinds], sp.piece_to_id("<0x00>"), size)

    def edges(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece) of all edges over the chunks laid end to end, and where each chunk starts.

        A chunk of n characters has n + 1 nodes; byte pieces of one character share its start and end node, as
        one edge whose piece is ~code point.
        """
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        chars = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        base = np.cumsum(sizes + 1) - (sizes + 1)
        of = np.repeat(np.arange(len(chunks)), sizes)
        node = np.arange(len(chars)) + of  # one more node for each chunk before it
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))
        out = []
        covered = np.zeros(len(chars), bool)
        at, state = np.arange(len(chars)), np.zeros(len(chars), np.int64)
        for depth in range(self.deepest):
            state = self.step(state, chars[at + depth])
            ok = state >= 0
            at, state = at[ok], state[ok]
            piece = self.ends[state]
            done = piece >= 0
            if depth == 0:
                covered[at[done]] = True
            out.append((node[at[done]], node[at[done]] + depth + 1, piece[done]))
            more = left[at] > depth + 1
            at, state = at[more], state[more]
            if not len(at):
                break
        bare = np.flatnonzero(~covered)
        out.append((node[bare], node[bare] + 1, ~chars[bare]))
        return *(np.concatenate(x) for x in zip(*out, strict=True)), base

    def filtered(self, chunks: list[str]) -> tuple[np.ndarray, ...]:
        """Edges (start, piece, cumulative posterior in 2**-32) sorted by end node, the first edge into each node, chunk starts and ends.

        Sums run in an order that depends on the chunk alone, so a chunk has the same keys in any batch.
        """
        start, end, piece, base = self.edges(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        code = ~piece
        n_bytes = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        w = np.where(piece >= 0, self.weight[np.maximum(piece, 0)], self.bare[n_bytes])
        total = int(base[-1] + sizes[-1] + 1)
        origin = np.zeros(total, np.int64)
        origin[base] = np.diff(base, prepend=0)
        origin = np.cumsum(origin)  # of each node, its chunk's start
        offset = end - origin[start]
        forward = np.zeros(total)
        forward[base] = 1.0
        whole = np.zeros(total, np.int64)
        whole[base] = sizes
        short = whole[origin[start]] <= LONG
        near = np.flatnonzero(short)
        order = near[np.argsort(offset[near].astype(np.uint8), kind="stable")]
        s, e, ww, off = start[order], end[order], w[order], offset[order]
        cuts = np.searchsorted(off, np.arange(1, LONG + 2))
        share, got = np.zeros(len(start)), np.zeros(len(s))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                got[a:b] = forward[s[a:b]] * ww[a:b]
                np.add.at(forward, e[a:b], got[a:b])
        share[order] = got / forward[e]
        if len(near) < len(start):
            logw = np.where(piece >= 0, self.logp[np.maximum(piece, 0)], n_bytes * self.logp[-1])
            self._long(start, end, logw, offset, np.flatnonzero(~short), origin[start], share)
        order = np.argsort(end * 32 + (end - start))  # no ties
        start, end, piece, share = start[order], end[order], piece[order], share[order]
        new = np.append(True, end[1:] != end[:-1])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(end)))
        c = share.copy()
        for k in range(1, int(many.max())):
            own = first[many > k] + k
            c[own] += c[own - 1]
        c = np.minimum((c * 2.0**32).astype(np.int64), (1 << 32) - 1)
        c[first + many - 1] = 1 << 32
        return start, piece, c, np.cumsum(np.bincount(end, minlength=total)) - np.bincount(end, minlength=total), base, base + sizes

    def codes(self, chunks: list[str]) -> np.ndarray:
        """Numbers of chunks among the known ones; new ones are filtered first."""
        if len(self.cum) > KEPT_EDGES:
            self.forget()
        new = [c for c in dict.fromkeys(chunks) if c not in self.known]
        if new:
            start, piece, cum, first, base, final = self.filtered(new)
            at, self.first = self.nodes, np.append(self.first, first + len(self.cum))
            self.known.update(zip(new, range(len(self.base), len(self.base) + len(new)), strict=True))
            self.base, self.final = np.append(self.base, base + at), np.append(self.final, final + at)
            self.start, self.piece, self.cum = np.append(self.start, (start + at).astype(np.int32)), np.append(self.piece, piece.astype(np.int32)), np.append(self.cum, cum)
            self.nodes = int(self.final[-1]) + 1
        return np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))

    @staticmethod
    def _long(start, end, logw, offset, which, base, share) -> None:
        """Chunks whose weights would leave the range of floats, in logarithms. Edges in order of their end; plain numbers, as a node has few."""
        which = which[np.lexsort((offset[which], base[which]))]
        ends = end[which]
        cuts = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), len(which)]
        starts, origins, weights, ends = start[which].tolist(), base[which].tolist(), logw[which].tolist(), ends.tolist()
        alpha = dict.fromkeys(origins, 0.0)
        out = [0.0] * len(which)
        exp, log, never = math.exp, math.log, -math.inf
        for a, b in zip(cuts, cuts[1:]):
            terms = [alpha.get(s, never) + w for s, w in zip(starts[a:b], weights[a:b], strict=True)]
            top = max(terms)
            whole = top + log(sum([exp(t - top) for t in terms]))
            alpha[ends[a]] = whole
            out[a:b] = [exp(t - whole) for t in terms]
        share[which] = out

    def encode(self, texts: list[str], keys: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each text)."""
        parts = [parted(t) if t else [] for t in texts]
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = [c for p in parts for c in p]
        if not flat:
            return np.empty(0, np.int32), np.zeros(len(texts), np.int64)
        code = self.codes(flat)
        row = np.repeat(np.arange(len(texts)), n)
        number = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        drawn = mixed(np.repeat(mixed(keys.astype(np.uint64) ^ np.uint64(seed)), n) + mixed(number.astype(np.uint64)))
        live, node, goal = np.arange(len(flat)), self.final[code], self.base[code]
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            u = mixed(drawn[live] + np.uint64(0x9E3779B97F4A7C15 * (len(steps) + 1) & MASK)) >> np.uint64(32)
            u = u.astype(np.int64)
            e = self.first[node]
            below = np.flatnonzero(self.cum[e] <= u)
            while len(below):  # the last edge into a node has 2**32, so this ends there
                e[below] += 1
                below = below[self.cum[e[below]] <= u[below]]
            steps.append((live, self.piece[e]))
            node = self.start[e].astype(np.int64)
            going = node != goal
            live, node, goal = live[going], node[going], goal[going]
        who = np.concatenate([a for a, _ in steps])
        when = np.repeat(np.arange(len(steps)), [len(a) for a, _ in steps])
        what = np.concatenate([b for _, b in steps])
        length = np.bincount(who, minlength=len(flat))
        place = np.cumsum(length)[who] - 1 - when  # drawn from the end
        out = np.empty(len(what), np.int64)
        out[place] = what
        counts = np.bincount(row, weights=length, minlength=len(texts)).astype(np.int64)
        return self._spelt(out, counts)

    def _spelt(self, pieces: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become their byte pieces."""
        bare = np.flatnonzero(pieces < 0)
        if not len(bare):
            return pieces.astype(np.int32), counts
        spelt = [chr(~p).encode("utf-8", "surrogatepass") for p in pieces[bare].tolist()]
        size = np.ones(len(pieces), np.int64)
        size[bare] = [len(b) for b in spelt]
        out = np.repeat(pieces, size)
        out[np.repeat(pieces < 0, size)] = np.frombuffer(b"".join(spelt), np.uint8).astype(np.int64) + self.bytes_from
        row = np.repeat(np.arange(len(counts)), counts)
        return out.astype(np.int32), np.bincount(row, weights=size, minlength=len(counts)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(self.surfaces[ids].tolist()).decode("utf-8", "surrogatepass")[1:]


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(texts: list[str | None], size: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size characters each."""
    at = held = 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield at, k + 1
            at, held = k + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _keys(column: pa.Array) -> np.ndarray:
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _encoded(found: Lattice, seed: int, texts: list[str | None], keys: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for a, b in slices(texts):
        yield a, b, *found.encode([t or "" for t in texts[a:b]], keys[a:b], seed)


def sent_model(spark: SparkSession, model: str | None = None) -> Sent:
    return Sent(spark, Path(model or default_model()).read_bytes())


def _lists(found: Lattice, seed: int, keys: pa.Array, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, list[str | None]]]:
    """(ids, counts, texts) of each slice."""
    own = _keys(keys)
    for a, b, ids, counts in _encoded(found, seed, texts, own):
        yield ids, counts, texts[a:b]


def _list_array(ids: list[np.ndarray], counts: list[np.ndarray], texts: list[str | None]) -> pa.Array:
    n = np.concatenate([np.zeros(1, np.int64), *counts]).cumsum()
    missing = pa.array([t is None for t in texts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])), mask=missing)


def encoder(model: Sent, seed: int = SEED):
    """An Arrow UDF (key, text) -> (pieces, decoded_ok): encoding and the check of decoding share a worker and its vocabulary."""

    @F.arrow_udf("pieces array<int>, decoded_ok boolean")
    def encode(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        found = Lattice.load(model.get())
        for keys, texts in parts:
            texts, ids, counts, ok = texts.to_pylist(), [], [], []
            for own, n, some in _lists(found, seed, keys, texts):
                ids.append(own)
                counts.append(n)
                for t, x in zip(some, np.split(own, np.cumsum(n)[:-1]), strict=True):
                    ok.append(t is None or found.decode(x) == t)
            yield pa.StructArray.from_arrays([_list_array(ids, counts, texts), pa.array(ok, pa.bool_())], ["pieces", "decoded_ok"])

    return encode


def decoder(model: Sent):
    """An Arrow UDF array<int> -> text."""

    @F.arrow_udf("string")
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        found = Lattice.load(model.get())
        for ids in parts:
            yield pa.array([None if i is None else found.decode(np.array(i, np.int64)) for i in ids.to_pylist()], pa.string())

    return decode


def encoded(docs: DataFrame, key: Column | str = "doc_id", text: Column | str = "text", into: str = "pieces", checked: str | None = None, model: str | None = None, seed: int = SEED) -> DataFrame:
    """docs with the sampled piece ids, and under the name checked whether decoding gives the text back; columns of those names are replaced."""
    bounded_batches(docs.sparkSession)
    key, text = (F.col(c) if isinstance(c, str) else c for c in (key, text))
    out = docs.withColumn("__px_p", encoder(sent_model(docs.sparkSession, model), seed)(key.cast("long"), text))
    return out.withColumns({into: F.col("__px_p.pieces")} | ({checked: F.col("__px_p.decoded_ok")} if checked else {})).drop("__px_p")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256 (of the ids as little-endian 32-bit numbers), decoded_sha256, lossless: a row per document.

    Encoding and decoding happen in one pass, so that piece lists needn't go through the JVM only to be digested.
    """
    model = sent_model(spark)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Lattice.load(model.get())
        for batch in batches:
            texts, out = batch.column(1).to_pylist(), []
            for a, b, ids, counts in _encoded(found, SEED, texts, _keys(batch.column(0))):
                at = 0
                for t, n in zip(texts[a:b], counts.tolist(), strict=True):
                    own, at = ids[at : at + n], at + n
                    if t is None:
                        out.append((None, None, None, True))
                        continue
                    back = found.decode(own)
                    out.append((n, hashlib.sha256(own.astype("<i4").tobytes()).hexdigest(), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == t))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True))], ["doc_id", "n_pieces", "pieces_sha256", "decoded_sha256", "lossless"])

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(rows, "doc_id long, n_pieces long, pieces_sha256 string, decoded_sha256 string, lossless boolean")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row stays and gets pieces (array of ids) and decoded_ok, which is true where decoding gives the text back."""
    return encoded(docs, checked="decoded_ok")
