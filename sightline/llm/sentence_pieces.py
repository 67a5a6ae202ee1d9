"""SentencePiece encoding and decoding, giant documents by a parallel scan.

The model at hand is of the BPE kind. A sequence of pieces is its encoding exactly
if every two neighbouring pieces are the encoding of their own concatenation, and
there is one such sequence: no merge across a final border was ever the best one,
and merges inside borders do not depend on what lies outside. So encoding is a
best path through a lattice of pieces whose edges weigh 0 where two pieces may
follow each other and minus infinity elsewhere: max-plus algebra.

A giant document is split into chunks. The state at a border is the piece that
reaches or crosses it. Each chunk yields a transfer matrix from the states at its
start to those at its end; the matrices are combined in a tree, whose products are
associative, and the tree's way down gives every border its state; then each chunk
is traced back on its own. Inside a
chunk, borders that no piece can span (a letter before a space, mostly) cut the
lattice; what lies between the first and the last of them depends on no border
state and is encoded by the library. Other documents are one chunk, which is
that case without borders. A giant text that many rows share is worked on once.

Null and empty texts have no pieces. Repeated rows each get a row, a null
``doc_id`` is passed through, and an empty table gives an empty result. Columns
other than doc_id and text are not read."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import join_counted, materialize

SPACE = "▁"
CHUNK = 1 << 15
#: Rows whose ids are Python integers at a time.
DIGEST_ROWS = 128
#: Rows with one giant text that are joined with one copy of its ids.
SHARE = 1000
PRIME = (1 << 31) - 1
BASE = 1_000_003
Span = tuple[int, int]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The model: its pieces, its library encoder, and its lattice."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n, t = proto.normalizer_spec, proto.trainer_spec
        if t.model_type != t.BPE or n.name != "identity" or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("the scan is for BPE models without normalisation")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == p.NORMAL}
        self.rank = {p.piece: -p.score for p in proto.pieces if p.type == p.NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == p.BYTE}
        self.text = {i: p for p, i in self.ids.items()}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = self.library.unk_id()
        self.longest = max(map(len, self.ids))
        self.inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.follows = functools.lru_cache(1 << 18)(self._follows)

    def merged(self, s: str) -> list[str]:
        """BPE of a short string: the best-ranked neighbours first, leftmost on ties."""
        parts = list(s)
        while True:
            ranks = [self.rank.get(a + b, float("inf")) for a, b in zip(parts, parts[1:])]
            best = min(ranks, default=float("inf"))
            if best == float("inf"):
                return parts
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _follows(self, a: str, b: str) -> bool:
        return self.merged(a + b) == [a, b]

    def cuts(self, a: str, b: str) -> bool:
        """Whether no piece spans the border between characters ``a`` and ``b``."""
        return a + b not in self.inside

    def spans_from(self, s: str, at: int, stop: int) -> list[Span]:
        """Lattice nodes that begin at ``at`` and end by ``stop``."""
        return [(at, e) for e in range(at + 1, min(stop, at + self.longest) + 1) if e == at + 1 or s[at:e] in self.ids]

    def ids_of(self, piece: str) -> list[int]:
        """A character without a piece falls back to its bytes."""
        if piece in self.ids:
            return [self.ids[piece]]
        return [self.bytes[b] for b in piece.encode()] if self.bytes else [self.unknown]

    def encode(self, text: str | None) -> list[int]:
        return self.library.encode(text) if text else []

    def encode_inner(self, s: str) -> list[int]:
        """Ids of escaped text that begins with an escaped space, which the
        library puts there itself."""
        return self.library.encode(s[1:].replace(SPACE, " ")) if len(s) > 1 else [i for p in self.merged(s) for i in self.ids_of(p)]

    def decode(self, ids, first: bool = True) -> str:
        """Text of ids, from pieces and runs of bytes; the first space, which
        encoding put there, is dropped from a document's ``first`` ids."""
        out = bytearray()
        for i in ids:
            out += self.text[i].encode() if i in self.text else bytes([self.byte_of[i]])
        text = out.decode(errors="replace").replace(SPACE, " ")
        return text[1:] if first and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def load(path: str) -> Pieces:
    return Pieces(path)


@dataclass
class Chunk:
    """Characters ``lo`` to ``hi`` of ``s``, which holds as many more on either
    side as a piece may reach, as far as the document goes."""

    s: str
    lo: int
    hi: int
    first: bool
    last: bool


def border_states(m: Pieces, s: str, at: int) -> list[Span]:
    """Pieces that reach or cross position ``at``, in a fixed order."""
    return [x for start in range(max(0, at - m.longest), at) for x in m.spans_from(s, start, len(s)) if x[1] >= at]


def _reach(m: Pieces, s: str, begin: dict[Span, int] | None, at: int, stop: int, until) -> dict[Span, int]:
    """For every span met, the bits of the begin states from which it can be
    reached; with ``begin`` None every path begins at ``at`` with bit 0."""
    seen: dict[Span, int] = dict(begin or {})
    ends: dict[int, list[Span]] = {}
    for x in seen:
        ends.setdefault(x[1], []).append(x)
    for p in range(at, stop):
        before = ends.get(p, [])
        root = begin is None and p == at
        if not before and not root:
            continue
        for x in m.spans_from(s, p, len(s)):
            if not until(x):
                continue
            bits = 1 if root else 0
            piece = s[x[0] : x[1]]
            for y in before:
                if seen[y] & ~bits and m.follows(s[y[0] : y[1]], piece):
                    bits |= seen[y]
            if bits:
                seen[x] = bits
                ends.setdefault(x[1], []).append(x)
    return seen


def _inner_cuts(m: Pieces, c: Chunk) -> tuple[int, int] | None:
    """First and last border inside the chunk that no piece can span and after
    which the library can begin."""
    ok = lambda p: c.s[p] == SPACE and m.cuts(c.s[p - 1], SPACE)
    first = next((p for p in range(c.lo + 1, c.hi) if ok(p)), None)
    return None if first is None else (first, next(p for p in range(c.hi - 1, c.lo, -1) if ok(p)))


def transfer(m: Pieces, c: Chunk) -> tuple[list[Span], list[Span], np.ndarray]:
    """States at the chunk's start and end, and 0 or -inf for each pair."""
    entry = [(0, 0)] if c.first else border_states(m, c.s, c.lo)
    exit_ = [(c.hi, c.hi)] if c.last else border_states(m, c.s, c.hi)
    matrix = np.full((len(entry), len(exit_)), -np.inf)
    cuts = _inner_cuts(m, c)

    def ends(seen: dict[Span, int], stop: int) -> int:
        return functools.reduce(int.__or__, (bits for x, bits in seen.items() if x[1] == stop), 0)

    def begin() -> dict[Span, int] | None:
        return None if c.first else {x: 1 << i for i, x in enumerate(entry)}

    def bits_at(seen: dict[Span, int], j: int) -> int:
        return ends(seen, c.hi) if c.last else seen.get(exit_[j], 0)

    if cuts is None:
        seen = _reach(m, c.s, begin(), c.lo, c.hi, lambda x: x[1] <= c.hi if c.last else True)
        for j in range(len(exit_)):
            bits = bits_at(seen, j)
            for i in range(len(entry)):
                if bits >> i & 1:
                    matrix[i, j] = 0.0
        return entry, exit_, matrix
    left = ends(_reach(m, c.s, begin(), c.lo, cuts[0], lambda x: x[1] <= cuts[0]), cuts[0])
    right = _reach(m, c.s, None, cuts[1], c.hi, lambda x: x[1] <= c.hi if c.last else True)
    for j in range(len(exit_)):
        if bits_at(right, j):
            for i in range(len(entry)):
                if left >> i & 1:
                    matrix[i, j] = 0.0
    return entry, exit_, matrix


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def trace(m: Pieces, c: Chunk, entry: Span, exit_: Span) -> list[int]:
    """Ids of the pieces that begin in the chunk, between two border states."""
    cuts = _inner_cuts(m, c)

    def back(begin, at: int, stop: int, until, last) -> list[int]:
        seen = _reach(m, c.s, begin, at, stop, until)
        x = last(seen)
        path = []
        while x is not None and not (begin is not None and x in begin):
            path.append(x)
            piece = c.s[x[0] : x[1]]
            x = next((y for y in seen if y[1] == x[0] and m.follows(c.s[y[0] : y[1]], piece)), None)
        return [i for a, b in reversed(path) for i in m.ids_of(c.s[a:b])]

    def to(stop: int):
        return lambda seen: next((x for x in seen if x[1] == stop), None)

    begin = None if c.first else {entry: 1}
    inside = (lambda x: x[1] <= c.hi) if c.last else (lambda x: True)
    final = to(c.hi) if c.last else (lambda seen: exit_ if exit_ in seen else None)
    if cuts is None:
        return back(begin, c.lo if c.first else entry[1], c.hi, inside, final)
    p, q = cuts
    left = back(begin, c.lo if c.first else entry[1], p, lambda x: x[1] <= p, to(p)) if c.first or entry[1] < p else []
    return left + (m.encode_inner(c.s[p:q]) if q > p else []) + back(None, q, c.hi, inside, final)


def split(m: Pieces, text: str, size: int):
    """Chunks of a document; borders lie ``size`` characters apart."""
    s = SPACE + text.replace(" ", SPACE)
    n = max(1, len(s) // size)
    for k in range(n):
        lo, hi = k * size, len(s) if k == n - 1 else (k + 1) * size
        a, b = max(0, lo - m.longest), min(len(s), hi + m.longest)
        yield k, Chunk(s[a:b], lo - a, hi - a, k == 0, k == n - 1)


def fold(ids: np.ndarray) -> int:
    """Sum of (id + 1) * BASE ** (ids after it), modulo PRIME."""
    h, powers = 0, _powers()
    for at in range(0, len(ids), 4096):
        part = ids[at : at + 4096].astype(np.int64) + 1
        h = (h * int(powers[len(part)]) + int((part * powers[: len(part)][::-1] % PRIME).sum())) % PRIME
    return h


@functools.lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    out = [1]
    for _ in range(4096):
        out.append(out[-1] * BASE % PRIME)
    return np.array(out, dtype=np.int64)


def _scan(states: list[tuple[list[Span], list[Span], np.ndarray]]) -> list[tuple[int, int]]:
    """Entry and exit state of every chunk. Up a tree, neighbours' matrices are
    multiplied; down it, the two ends of a product's best path give the state at its
    middle."""
    levels = [[matrix for _, _, matrix in states]]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([times(*below[k : k + 2]) if k + 1 < len(below) else below[k] for k in range(0, len(below), 2)])
    ends = [tuple(int(x) for x in np.unravel_index(levels[-1][0].argmax(), levels[-1][0].shape))]
    for below in levels[-2::-1]:
        down = []
        for k, (i, j) in enumerate(ends):
            if 2 * k + 1 < len(below):
                middle = int((below[2 * k][i] + below[2 * k + 1][:, j]).argmax())
                down += [(i, middle), (middle, j)]
            else:
                down.append((i, j))
        ends = down
    return ends


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text (null is empty) and a number that tells rows apart."""
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _giant(docs: DataFrame, chunk: int) -> DataFrame:
    """row, doc_id, text and its digest ``_key`` of the rows of a chunk or more."""
    long_ = _numbered(docs).where(F.length("text") >= chunk)
    return long_.select((-1 - F.col("row")).alias("row"), "doc_id", "text", F.unhex(F.sha2("text", 256)).alias("_key"))


def encode_short(docs: DataFrame, model_path: str, chunk: int) -> DataFrame:
    """row, doc_id and ids of every row whose text is shorter than a chunk."""

    def whole(batches):
        m = load(model_path)
        for b in batches:
            for at in range(0, len(b), DIGEST_ROWS):
                part = b.slice(at, DIGEST_ROWS)
                ids = m.library.encode(part.column(2).to_pylist(), num_threads=1)
                ids = [x if t.as_py() else [] for x, t in zip(ids, part.column(2), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["row", "doc_id", "ids"])

    short = _numbered(docs).where(F.length("text") < chunk)
    return short.mapInArrow(whole, short.select("row", "doc_id").schema.add("ids", ArrayType(IntegerType())))


def encode_giant(spark: SparkSession, texts: DataFrame, path: str, chunk: int) -> DataFrame:
    """_key, chunk and ids of every chunk of ``texts`` (_key, text)."""

    def chunks(batches):
        m = load(path)
        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                for k, c in split(m, text.as_py(), chunk):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.binary()), pa.array([k], pa.int32()), pa.array([c.s]), pa.array([c.lo], pa.int32()), pa.array([c.hi], pa.int32()), pa.array([c.first]), pa.array([c.last])], names=["_key", "chunk", "s", "lo", "hi", "first", "last"])

    parts = texts.select("_key", "text").mapInArrow(chunks, "_key binary, chunk int, s string, lo int, hi int, first boolean, last boolean")
    parts = materialize(spark, parts, "chunks")

    def of(row: dict) -> Chunk:
        return Chunk(row["s"], row["lo"], row["hi"], row["first"], row["last"])

    def transfers(batches):
        m = load(path)
        for b in batches:
            for row in b.to_pylist():
                c = of(row)
                entry, exit_, matrix = transfer(m, c)
                # A border's states are written relative to it, as either side sees them.
                rel = [[[a - c.lo, z - c.lo] for a, z in entry], [[a - c.hi, z - c.hi] for a, z in exit_]]
                yield pa.RecordBatch.from_arrays([pa.array([row["_key"]], pa.binary()), pa.array([row["chunk"]], pa.int32()), *[pa.array([x], pa.list_(pa.list_(pa.int32()))) for x in rel], pa.array([matrix.tobytes()], pa.binary())], names=["_key", "chunk", "entry", "exit", "matrix"])

    matrices = parts.mapInArrow(transfers, "_key binary, chunk int, entry array<array<int>>, exit array<array<int>>, matrix binary")

    def scan(table: pa.Table) -> pa.Table:
        # A text is under 2 GB, so a document has at most 2^16 chunks of the default size, of some hundred bytes each here.
        rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
        states = [(r["entry"], r["exit"], np.frombuffer(r["matrix"]).reshape(len(r["entry"]), len(r["exit"]))) for r in rows]
        found = [(r["_key"], r["chunk"], r["entry"][i], r["exit"][j]) for r, (i, j) in zip(rows, _scan(states), strict=True)]
        key, number, entry, exit_ = zip(*found, strict=True)
        spans = pa.list_(pa.int32())
        return pa.table({"_key": pa.array(key, pa.binary()), "chunk": pa.array(number, pa.int32()), "entry": pa.array(entry, spans), "exit": pa.array(exit_, spans)})

    chosen = matrices.groupBy("_key").applyInArrow(scan, "_key binary, chunk int, entry array<int>, exit array<int>")

    def traces(batches):
        m = load(path)
        for b in batches:
            for row in b.to_pylist():
                c = of(row)
                entry, exit_ = ((x[0] + at, x[1] + at) for x, at in ((row["entry"], c.lo), (row["exit"], c.hi)))
                ids = trace(m, c, entry, exit_)
                yield pa.RecordBatch.from_arrays([pa.array([row["_key"]], pa.binary()), pa.array([row["chunk"]], pa.int32()), pa.array([ids], pa.list_(pa.int32()))], names=["_key", "chunk", "ids"])

    return parts.join(chosen, ["_key", "chunk"]).mapInArrow(traces, "_key binary, chunk int, ids array<int>")


def _distinct(giant: DataFrame) -> DataFrame:
    """_key, text and n (rows that have it) of the distinct texts; first() combines
    before the shuffle."""
    return giant.groupBy("_key").agg(F.first("text").alias("text"), F.count("*").alias("n"))


def encode_ids(spark: SparkSession, docs: DataFrame, model_path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """row (a number that tells rows apart), doc_id, chunk (from 0) and ids of every
    chunk of every row of ``docs``."""
    path, giant = model_path or default_path(), _giant(docs, chunk)
    texts = materialize(spark, _distinct(giant), "texts")
    encoded = materialize(spark, encode_giant(spark, texts, path, chunk), "giant-ids")
    # Rows of one text are dealt over as many copies of its chunks as SHARE rows each make.
    n = texts.select("_key", F.ceil(F.col("n") / SHARE).alias("_n"))
    copies = encoded.join(n, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n")
    rows = giant.select("row", "doc_id", "_key").join(n, "_key").withColumn("_copy", 1 + F.pmod(F.xxhash64("row"), F.col("_n"))).drop("_n")
    whole = encode_short(docs, path, chunk).select("row", "doc_id", F.lit(0).alias("chunk"), "ids")
    return whole.unionByName(rows.join(copies, ["_key", "_copy"]).select("row", "doc_id", "chunk", "ids"))


def decode_ids(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """row, doc_id and text of what encode_ids() made: chunks are decoded one by one,
    and a row's are put together."""
    path = model_path or default_path()

    def kernel(batches):
        m = load(path)
        for whole in batches:
            for start in range(0, len(whole), DIGEST_ROWS):
                b = whole.slice(start, DIGEST_ROWS)
                text = [m.decode(ids.as_py(), first=k == 0) for k, ids in zip(b.column(2).to_pylist(), b.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(text, pa.string())], names=["row", "doc_id", "chunk", "text"])

    parts = encoded.select("row", "doc_id", "chunk", "ids")
    parts = parts.mapInArrow(kernel, encoded.select("row", "doc_id", "chunk").schema.add("text", "string"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "")
    return parts.groupBy("row", "doc_id").agg(joined.alias("text"))


def digest(encoded: DataFrame, model_path: str, key: str) -> DataFrame:
    """``key``, chunk, n, h (the ids' hash), p (BASE ** n) and the bytes that the
    ids decode to, for rows with ``key``, chunk and ids."""

    def kernel(batches):
        m = load(model_path)
        for whole in batches:
            for start in range(0, len(whole), DIGEST_ROWS):  # decoding takes ids as Python integers
                b = whole.slice(start, DIGEST_ROWS)
                parts = [x.values.to_numpy() for x in b.column(2)]
                n = [len(x) for x in parts]
                # The library drops the first space, which encoding put before the text; a later chunk's first space stays.
                size = [len(t.encode()) for t in m.library.decode([x.tolist() for x in parts])] if parts else []
                size = [k + bool(c and len(x) and m.text.get(int(x[0]), "").startswith(SPACE)) for k, c, x in zip(size, b.column(1).to_pylist(), parts, strict=True)]
                columns = [pa.array(x, pa.int64()) for x in (n, [fold(x) for x in parts], [pow(BASE, k, PRIME) for k in n], size)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=[key, "chunk", "n", "h", "p", "n_bytes"])

    schema = encoded.select(key, "chunk").schema
    for name in ("n", "h", "p", "n_bytes"):
        schema = schema.add(name, "long")
    return encoded.select(key, "chunk", "ids").mapInArrow(kernel, schema)


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_pieces, ids_hash of all ids in order (see fold), and the
    length in bytes of the text that the ids decode to."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), default_path()
    short = digest(encode_short(docs, path, CHUNK).withColumn("chunk", F.lit(0)), path, "doc_id")
    giant = _giant(docs, CHUNK)
    texts = materialize(spark, _distinct(giant), "texts")
    parts = digest(encode_giant(spark, texts, path, CHUNK), path, "_key").groupBy("_key")
    hashed = F.aggregate(F.array_sort(F.collect_list(F.struct("chunk", "h", "p"))), F.lit(0).cast("long"), lambda a, x: (a * x["p"] + x["h"]) % PRIME)
    found = parts.agg(F.sum("n").alias("n_pieces"), hashed.alias("ids_hash"), F.sum("n_bytes").alias("decoded_bytes"))
    found = materialize(spark, found.join(texts.select("_key", F.col("n").alias("_rows")), "_key"), "giants")
    giant = join_counted(giant.select("doc_id", "_key"), found, ["_key"], "_rows", found.agg(F.sum("_rows")).collect()[0][0] or 0).drop("_key", "_rows")
    return short.select("doc_id", F.col("n").alias("n_pieces"), F.col("h").alias("ids_hash"), F.col("n_bytes").alias("decoded_bytes")).unionByName(giant)
