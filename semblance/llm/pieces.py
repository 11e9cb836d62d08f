"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised as the library does (a leading mark, spaces as marks) and cut
between characters that stand side by side in no piece, where no merge can reach
across.  The cuts of a batch are encoded as a dictionary.  Within a cut that is
new, adjacent symbol pairs whose concatenation is a piece wait on an agenda ordered
by score, then position; the best pair merges until none is left, and characters
without a piece become bytes.  Ids and decoded texts are taken from the dictionary
for the whole batch.  Every distinct cut that a worker meets is also encoded by the
sentencepiece library, in one call for each batch, and must agree.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semblance.llm.text import picked
from semblance.session import ship

MARK = "▁"
CACHE = 300_000  # distinct cuts a worker remembers
CACHE_CHARS = 16_000_000  # characters of these together
BATCH = 1_000_000  # characters of texts that are encoded at once, or one text
SHORT = 40  # characters up to which a list is the faster agenda
NEVER = float("inf")  # the rank of a pair that is no piece

_LOADED: dict[bytes, "Pieces"] = {}


class Pieces:
    """The vocabulary of one model file and the cuts encoded so far."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [(i, sp.id_to_piece(i)) for i in range(sp.vocab_size())]
        plain = [(i, p) for i, p in names if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id = {p: i for i, p in plain}
        # The agenda takes the smallest first.
        self.rank = {p: -sp.get_score(i) for i, p in plain if len(p) > 1}
        self.byte = {int(p[3:5], 16): i for i, p in names if sp.is_byte(i)}
        if len(self.byte) != 256 or any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in self.id):
            raise ValueError("a merge-type vocabulary with byte pieces and marks only in front is needed")
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        self.text = {i: p.replace(MARK, " ") for i, p in plain}
        self.value = {i: v for v, i in self.byte.items()}
        # Characters that stand beside others in some piece have a number; ``joins`` says which of them do so in that order.
        beside = {pair for p in self.id for pair in zip(p, p[1:])}
        number = {c: i for i, c in enumerate(sorted({c for pair in beside for c in pair}), 1)}
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in number]] = list(number.values())
        self.width = len(number) + 1
        self.joins = np.zeros(self.width * self.width, bool)
        self.joins[[number[a] * self.width + number[b] for a, b in beside]] = True
        self.ids: dict[str, bytes] = {}
        self.plain: dict[str, str] = {}
        self.new: list[str] = []
        self.chars = 0

    def cuts(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All cuts of the texts one after the other, and the number of the first of each text (and behind the last)."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        starts = np.cumsum([0] + [len(m) for m in marked])
        body = "".join(marked)
        points = np.frombuffer(body.encode("utf-32-le"), np.uint32)
        kind = self.kind[points]
        apart = np.ones(len(points), bool)
        apart[1:] = ~self.joins[kind[:-1] * self.width + kind[1:]]
        apart[starts[:-1][starts[:-1] < len(points)]] = True
        at = np.flatnonzero(apart)
        size = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF).astype(np.int64)
        place = np.concatenate([[0], np.cumsum(size)])
        offsets = place[np.append(at, len(points))].astype(np.int64)
        cuts = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(body.encode()))
        return cuts, np.searchsorted(at, starts)

    def learn(self, cut: str) -> None:
        """Ids and text of a new cut, noted for the batch's check."""
        ids = self.merged(cut)
        self.ids[cut] = struct.pack(f"<{len(ids)}I", *ids)
        # Most cuts decode to themselves; only the others are kept.
        if (text := self.spelled(ids)) != cut.replace(MARK, " "):
            self.plain[cut] = text
        self.new.append(cut)
        self.chars += len(cut)

    def merged(self, cut: str) -> list[int]:
        symbols = self._short(cut) if len(cut) <= SHORT else self._long(cut)
        out, ids, byte = [], self.id, self.byte
        for s in symbols:
            if (i := ids.get(s)) is not None:
                out.append(i)
            else:
                out += [byte[b] for b in s.encode()]
        return out

    def _short(self, cut: str) -> list[str]:
        """The agenda as a list of the pairs' ranks in text order: its first smallest entry is the next pair."""
        rank, symbols = self.rank.get, list(cut)
        agenda = [rank(a + b, NEVER) for a, b in zip(cut, cut[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            piece = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i < len(agenda):
                agenda[i] = rank(piece + symbols[i + 1], NEVER)
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + piece, NEVER)
        return symbols

    def _long(self, cut: str) -> list[str]:
        """The agenda as a heap of (rank, position, piece), so that long runs stay near linear."""
        n, rank = len(cut), self.rank
        symbols, after, before = list(cut), list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(rank[p], i, p) for i in range(n - 1) if (p := cut[i : i + 2]) in rank]
        heapify(agenda)
        while agenda:
            _, i, piece = heappop(agenda)
            j = after[i]
            # Stale: one of the two symbols has since become part of another.
            if j >= n or symbols[i] + symbols[j] != piece or not symbols[i]:
                continue
            symbols[i], symbols[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := piece + symbols[k]) in rank:
                    heappush(agenda, (rank[p], i, p))
            h = before[i]
            if h >= 0 and (p := symbols[h] + piece) in rank:
                heappush(agenda, (rank[p], h, p))
        return [s for s in symbols if s]

    def spelled(self, ids: list[int]) -> str:
        """The text of one cut's ids; runs of byte pieces are UTF-8."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.value:
                run.append(self.value[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.text[i])
        return "".join(out) + run.decode("utf-8", "replace")

    def encode_all(self, texts: list[str]) -> tuple[pa.Array, pa.Array, pa.Array]:
        """Number of ids, ids between begin and end as little-endian bytes, and the text they decode to, of every text."""
        cuts, first = self.cuts(texts)
        coded = cuts.dictionary_encode()
        known = coded.dictionary.to_pylist()
        for cut in known:
            if cut not in self.ids:
                self.learn(cut)
        edges = [struct.pack("<I", i) for i in (self.begin, self.end)]
        ids = pa.array([self.ids[c] for c in known] + edges, pa.large_binary())
        spelled = pa.array([self.plain[c] if c in self.plain else c.replace(MARK, " ") for c in known], pa.large_string())
        at, n = coded.indices.to_numpy(), len(texts)
        # Begin and end stand around each text's cuts.
        begins, ends = first[:-1] + 2 * np.arange(n), first[1:] + 2 * np.arange(n) + 1
        every, inside = np.empty(len(at) + 2 * n, np.int64), np.ones(len(at) + 2 * n, bool)
        every[begins], every[ends] = len(known), len(known) + 1
        inside[begins] = inside[ends] = False
        every[inside] = at
        ids, size = _joined(ids.take(pa.array(every)), np.append(begins, len(every)))
        texts, _ = _joined(spelled.take(coded.indices), first)
        # The leading mark is not part of the text.
        return pa.array(size // 4), ids.cast(pa.binary()), pc.utf8_slice_codeunits(texts, 1).cast(pa.string())

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids and decoded text of one text."""
        _, ids, decoded = self.encode_all([text])
        return ids[0].as_py(), decoded[0].as_py()

    def check(self) -> None:
        """Every new cut as the library encodes it behind a line feed; bounds the memory afterwards."""
        if self.new:
            lead = len(self.library.encode("\n"))
            theirs = self.library.encode(["\n" + c.replace(MARK, " ") for c in self.new], num_threads=1)
            for cut, ids in zip(self.new, theirs):
                if struct.pack(f"<{len(ids) - lead}I", *ids[lead:]) != self.ids[cut]:
                    raise ValueError(f"the library encodes {cut!r} otherwise")
            self.new = []
        if len(self.ids) > CACHE or self.chars > CACHE_CHARS:
            self.ids.clear()
            self.plain.clear()
            self.chars = 0


def _joined(parts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Neighbouring entries of a string array run together, from each ``first`` to the next; and their sizes in bytes."""
    _, offsets, data = parts.buffers()
    place = np.frombuffer(offsets, np.int64)[parts.offset : parts.offset + len(parts) + 1] if len(parts) else np.zeros(1, np.int64)
    place = place[first]
    return pa.Array.from_buffers(parts.type, len(first) - 1, [None, pa.py_buffer(place), data if data is not None else pa.py_buffer(b"")]), np.diff(place)


def loaded(model: bytes) -> Pieces:
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids (little-endian unsigned 32-bit, begin and end included), decoded.

    A null text is empty and has the ids begin and end; repeated rows each give a row; ids may be null; an empty table
    gives an empty one; other columns are not read.  The model file is read once on the driver; its size is fixed.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model.value)
        for batch in batches:
            size = np.cumsum(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False))
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + BATCH, side="right")))
                part = batch.slice(first, last - first)
                done = pieces.encode_all(part.column(1).to_pylist())
                pieces.check()
                yield pa.RecordBatch.from_arrays([part.column(0), *done], ["doc_id", "n_tokens", "ids", "decoded"])
                first = last

    plain = picked(docs, id_col, text_col).toDF("doc_id", "text")
    kind = plain.schema["doc_id"].dataType.simpleString()
    plain = plain.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary, decoded string")


def digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
