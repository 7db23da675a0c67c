"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three parts are compiled once: the normaliser (the model's character map, collapsing of blanks, blank to U+2581
and a leading one; see ``normaliser``), the piece
transducer (a trie whose accepting arcs emit piece ids) and byte fallback (a character that no
piece covers emits its UTF-8 bytes). A text is composed with them into a lattice over its
positions, and the tropical-semiring shortest path gives the ids.

For a unigram model an arc weighs minus its piece's score. For a BPE model the weights sit on
pairs: an arc may follow another at weight 0 if merging their joined text gives exactly the two
pieces, else at infinity. A sequence in which all neighbours fit is the BPE result, there is one
for every prefix, and so each position keeps one finite state: the last piece.

Where no piece has U+2581 behind another character, paths through different words share no
piece, so the lattice is cut there and words are memoised in a bounded table.

Defined cases: a null text encodes like an empty one, to no ids; any other text decodes to its normal form
(itself, for a model without a character map), except that U+2581 in it comes back as a blank; ids of control pieces decode to nothing; byte
ids that aren't UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeseek.llm.common import bounded_batches, read_table
from lakeseek.llm.normaliser import SPACE, Normaliser

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, BYTE, UNUSED = 1, 2, 3, 4, 6, 5
MEMO = 400_000
PAIRS = 1_000_000
_NONE, _BYTES = -2, -3


def load(path: str = MODEL) -> dict:
    """What the transducer needs of a model file: pieces, scores, types and whether it is BPE."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec = model.normalizer_spec
    if not spec.escape_whitespaces:
        raise ValueError("only models that write blanks as U+2581 are supported")
    if model.trainer_spec.model_type not in (1, 2) or model.trainer_spec.treat_whitespace_as_suffix:
        raise ValueError("only unigram and BPE models with U+2581 in front are supported")
    return {
        "pieces": [p.piece for p in model.pieces], "scores": [p.score for p in model.pieces], "types": [p.type for p in model.pieces],
        "bpe": model.trainer_spec.model_type == 2, "prefix": spec.add_dummy_prefix, "charsmap": spec.precompiled_charsmap, "collapse": spec.remove_extra_whitespaces,
    }


class Transducer:
    def __init__(self, model: dict):
        self.pieces, self.scores, self.prefix, self.bpe = model["pieces"], model["scores"], model["prefix"], model["bpe"]
        self.normal = Normaliser(model.get("charsmap", b""), model.get("collapse", False), self.prefix)
        self.unknown = model["types"].index(UNKNOWN)
        self.byte = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(self.pieces, model["types"])) if t == BYTE}
        self.ids, self.root = {}, ({}, [_NONE])
        self.raw = []
        for i, (piece, kind) in enumerate(zip(self.pieces, model["types"])):
            self.raw.append(bytes([int(piece[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode())
            if kind in (NORMAL, USER):
                self.ids[piece] = i
                node = self.root
                for c in piece:
                    node = node[0].setdefault(c, ({}, [_NONE]))
                node[1][0] = i
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.words = None if inner else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.pairs, self.memo = {}, _Memo(self)

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best neighbours first, leftmost on ties."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def follows(self, u: int, v: int) -> bool:
        """Whether the arc of piece v may come behind that of piece u (the number of pieces: a fresh start)."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        want = [self.pieces[v]] if u == len(self.pieces) else [self.pieces[u], self.pieces[v]]
        found = self.pairs[u << 20 | v] = self.merged("".join(want)) == want
        return found

    def shortest_path(self, text: str) -> list[int]:
        return self._pair_path(text) if self.bpe else self._weight_path(text)

    def _bytes(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode()] if self.byte else [self.unknown]

    def _pair_path(self, text: str) -> list[int]:
        """The one path of finite weight, depth first with the longest arc in front.

        A finite path to a position is the only one, so a position that leads nowhere is never
        entered again and each position's arcs are tried once.
        """
        n, root, follows, pairs, fresh = len(text), self.root[0], self.follows, self.pairs, len(self.pieces)
        path: list[int] = []
        trail: list[tuple[int, int, list]] = []
        dead: set[int] = set()
        at, u = 0, fresh
        while at < n:
            node, k, arcs = root.get(text[at]), at + 1, []
            if node is None or node[1][0] == _NONE:
                arcs.append((k, _BYTES))  # such a character merges with nothing
                node = None
            while node is not None:
                v = node[1][0]
                if v >= 0:
                    arcs.append((k, v))
                if k == n:
                    break
                node = node[0].get(text[k])
                k += 1
            while True:
                row, to = u << 20, at
                while arcs:
                    k, v = arcs.pop()
                    if k in dead:
                        continue
                    if v != _BYTES:
                        fits = pairs.get(row | v)
                        if not (follows(u, v) if fits is None else fits):
                            continue
                    to = k
                    break
                if to > at:
                    trail.append((at, u, arcs))
                    path.append(v)
                    at, u = to, fresh if v == _BYTES else v
                    break
                dead.add(at)
                at, u, arcs = trail.pop()
                path.pop()
        if _BYTES not in path:
            return path
        return [i for (place, _, _), v in zip(trail, path) for i in (self._bytes(text[place]) if v == _BYTES else (v,))]

    def _weight_path(self, text: str) -> list[int]:
        n, root = len(text), self.root[0]
        least = min(self.scores)
        cost, last = [0.0] + [float("inf")] * n, [_NONE] * (n + 1)
        for j in range(n):
            node, k = root.get(text[j]), j + 1
            if (node is None or node[1][0] == _NONE) and cost[j] + 10 - least < cost[k]:
                cost[k], last[k] = cost[j] + 10 - least, _BYTES
            while node is not None:
                v = node[1][0]
                if v >= 0 and cost[j] - self.scores[v] < cost[k]:
                    cost[k], last[k] = cost[j] - self.scores[v], v
                if k == n:
                    break
                node = node[0].get(text[k])
                k += 1
        out, at = [], n
        while at > 0:
            v = last[at]
            out.extend(reversed(self._bytes(text[at - 1])) if v == _BYTES else (v,))
            at -= 1 if v == _BYTES else len(self.pieces[v])
        out.reverse()
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        normal = self.normal(text)
        if not normal:
            return []
        if self.words is None:
            return self.shortest_path(normal)
        out: list[int] = []
        for ids in map(self.memo.__getitem__, self.words(normal)):
            out += ids
        return out

    def plain(self, text: str | None) -> str:
        """What decoding the text's ids gives back: its normal form with blanks."""
        return self._unprefixed(self.normal(text or "").replace(SPACE, " "))

    def _unprefixed(self, text: str) -> str:
        """Without the leading blank of the normaliser; where it collapses blanks, without any leading one."""
        if self.normal.collapse:
            return text.lstrip(" ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def decode(self, ids) -> str:
        raw = self.raw
        return self._unprefixed(b"".join([raw[i] for i in ids]).decode("utf-8", "replace"))


class _Memo(dict):
    """Ids of words; emptied when it is full. Long words are not kept."""

    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, word: str) -> list[int]:
        ids = self.transducer.shortest_path(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = ids
        return ids


_COMPILED: dict = {}


def _compiled(shared) -> Transducer:
    """The transducer of a broadcast model, compiled once per Python worker."""
    if shared.value["key"] not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[shared.value["key"]] = Transducer(shared.value)
    return _COMPILED[shared.value["key"]]


def _share(spark: SparkSession, path: str):
    bounded_batches(spark)
    model = load(path)
    model["key"] = hashlib.sha256(repr(sorted(model.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast(model)  # as large as the vocabulary file


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and ids (array<int>) of every row of ``docs``."""
    shared = _share(docs.sparkSession, path)

    def work(batches):
        t = _compiled(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [np.array(t.encode(x), np.int32) for x in part.column("text").to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), column], ["doc_id", "ids"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of every row of ``encoded`` (doc_id, ids)."""
    shared = _share(encoded.sparkSession, path)

    def work(batches):
        t = _compiled(shared)
        for batch in batches:
            texts = [t.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    schema = T.StructType([T.StructField("doc_id", encoded.schema["doc_id"].dataType), T.StructField("text", T.StringType())])
    return encoded.select("doc_id", "ids").mapInArrow(work, schema)


def digests(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids_sha256 (little-endian int32) and whether decoding gives the text back."""
    shared = _share(docs.sparkSession, path)

    def work(batches):
        t = _compiled(shared)
        low, high = (min(t.byte.values()), max(t.byte.values())) if t.byte else (0, -1)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                ids = t.encode(text)
                flat = np.array(ids, "<i4")
                rows.append((len(ids), int(((flat >= low) & (flat <= high)).sum()), hashlib.sha256(flat.tobytes()).hexdigest(), t.decode(ids) == t.plain(text)))
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_ids", "n_byte_ids", "ids_sha256", "round_trip"])

    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_ids", T.LongType()), T.StructField("n_byte_ids", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType()),
    ])
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents")).select("doc_id", "n_ids", "n_byte_ids", "ids_sha256", F.col("round_trip"))
