"""Alignment of two tokenizers: token-byte incidence matrices in CSR form, linked by row products."""

from __future__ import annotations

import hashlib
import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from faultlens.llm.textops import blobs, slices
from faultlens.sources.stage import stage

A_PATH = "/opt/tokenizers/byte_bpe_50k.json"
B_PATH = "/opt/tokenizers/piece_bpe_32k.model"
SLICE_BYTES = 250_000  # text bytes encoded and aligned at a time
SLICE_LINKS = 250_000
PRODUCT_ENTRIES = 4_000_000  # so many entries of a product are worked out at a time
# how byte-level vocabularies part a text before merging (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# --- matrices ---------------------------------------------------------------------------------------------------------


@dataclass
class Csr:
    """A sparse matrix of ones: the columns of row i are ``indices[indptr[i]:indptr[i + 1]]``."""

    indptr: np.ndarray
    indices: np.ndarray
    n_columns: int

    @property
    def n_rows(self) -> int:
        return len(self.indptr) - 1


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … (lengths[0] numbers), then the same for the next."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)


def byte_incidence(ends: np.ndarray, n_bytes: int) -> Csr:
    """Tokens x bytes, for tokens that lie side by side and end at ``ends``."""
    return Csr(np.concatenate([[0], ends]), np.arange(n_bytes), n_bytes)


def one_per_row(columns: np.ndarray, n_columns: int) -> Csr:
    return Csr(np.arange(len(columns) + 1), columns, n_columns)


def transpose(m: Csr) -> Csr:
    rows = np.repeat(np.arange(m.n_rows), np.diff(m.indptr))
    counts = np.bincount(m.indices, minlength=m.n_columns)
    ordered = m.indices
    if len(ordered) and (ordered[1:] < ordered[:-1]).any():
        rows = rows[np.argsort(ordered, kind="stable")]
    return Csr(np.concatenate([[0], np.cumsum(counts)]), rows, m.n_rows)


def product(left: Csr, right: Csr) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, columns and values of left · right, row by row: row i is the sum of the rows of ``right`` that row i of ``left`` names.

    Whole rows are worked out together until they would have more than ``PRODUCT_ENTRIES`` entries before adding up.
    """
    widths = np.diff(right.indptr)[left.indices]
    work = np.concatenate([[0], np.cumsum(widths)])[left.indptr]
    whole = left.n_rows > 0 and work[-1] <= PRODUCT_ENTRIES
    for first, last in [(0, left.n_rows)] if whole else slices(np.diff(work).tolist(), PRODUCT_ENTRIES):
        start, end = left.indptr[first], left.indptr[last]
        rows = np.repeat(np.repeat(np.arange(first, last), np.diff(left.indptr[first:last + 1])), widths[start:end])
        columns = right.indices[_spread(right.indptr[left.indices[start:end]], widths[start:end])]
        key = rows * right.n_columns + columns
        if not len(key):
            continue
        if (key[1:] < key[:-1]).any():
            key = np.sort(key)
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        yield key[new] // right.n_columns, key[new] % right.n_columns, np.diff(np.concatenate([new, [len(key)]]))


def whole_product(left: Csr, right: Csr) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = list(product(left, right))
    return tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, np.int64),) * 3


# --- tokenizers -------------------------------------------------------------------------------------------------------


def _byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else the next above 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {**{chr(b): b for b in prints}, **{chr(256 + k): b for k, b in enumerate(others)}}


class Pair:
    """Both tokenizers, loaded from the bytes of their files, and the bytes of their tokens."""

    def __init__(self, a_file: bytes, b_file: bytes):
        spec, alphabet = json.loads(a_file), _byte_alphabet()
        vocab = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items()}
        n_a = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        self.a_bytes = [b""] * n_a
        for piece, i in vocab.items():
            self.a_bytes[i] = piece
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if all(spec["model"]["vocab"][x + y] == 256 + k for k, (x, y) in enumerate(merges)):  # ids are ranks
            self._ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        else:
            self._ranked, self._merged = None, Tokenizer.from_str(a_file.decode())
            self._merged.encode_special_tokens = True
        self._pieces = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        pieces = [self._pieces.id_to_piece(i) for i in range(self._pieces.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self._pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_length = np.array(list(map(len, self.a_bytes)), np.int64)
        self.b_length = np.array(list(map(len, self.b_bytes)), np.int64)
        self.pairs = self._ending_pairs()
        # an id with what follows it: the next of its side, the other side, the next group
        self._written = [f"{i}{sep}".encode() for sep in ",|;" for i in range(max(n_a, len(pieces)))]

    def _ending_pairs(self) -> np.ndarray:
        """Sorted codes of all id pairs that can end together: one token's bytes end with the other's.

        Their number follows from the vocabularies alone: each token ends in no more strings than it has bytes.
        """
        a_ids, b_ids = defaultdict(list), defaultdict(list)
        for ids, pieces in ((a_ids, self.a_bytes), (b_ids, self.b_bytes)):
            for i, piece in enumerate(pieces):
                if piece:
                    ids[piece].append(i)
        found = {(a, b) for a, piece in enumerate(self.a_bytes) for k in range(len(piece)) for b in b_ids.get(piece[k:], ())}
        found |= {(a, b) for b, piece in enumerate(self.b_bytes) for k in range(len(piece)) for a in a_ids.get(piece[k:], ())}
        return np.sort(np.array([a * len(self.b_bytes) + b for a, b in found], np.int64))

    def encode(self, blob: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of blank + text by both; None without text, or where a tokenizer doesn't keep the bytes."""
        if not blob:
            return None
        try:
            text, want = blob.decode(), b" " + blob
        except UnicodeDecodeError:
            return None
        b = self._pieces.encode(text)
        if b"".join(map(self.b_bytes.__getitem__, b)) != want:
            return None
        if self._ranked is not None:  # merges bytes by rank, so it keeps them
            a = self._ranked.encode_ordinary(" " + text)
        else:
            a = self._merged.encode(" " + text, add_special_tokens=False).ids
            if b"".join(map(self.a_bytes.__getitem__, a)) != want:
                return None
        return np.array(a, np.int64), np.array(b, np.int64)

    def write_groups(self, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray) -> bytes:
        """``a1,a2|b1;a3|b2,b3``: the ids of each group in order."""
        n = len(self._written) // 3
        a_last = np.concatenate([a_group[1:] != a_group[:-1], [True]])
        b_last = np.concatenate([b_group[1:] != b_group[:-1], [True]])
        out = np.empty(len(a) + len(b), np.int64)
        # a token comes after those of its own side and those of the other side in earlier groups (for B: up to its own)
        out[np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")] = a + n * a_last
        out[np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")] = b + 2 * n * b_last
        return b"".join(map(self._written.__getitem__, out.tolist()))[:-1]


@dataclass
class Files:
    """Contents of both vocabulary files, sent to the tasks; each Python worker loads them once."""

    a_file: bytes
    b_file: bytes

    def load(self) -> Pair:
        key = hashlib.sha256(self.a_file).digest() + hashlib.sha256(self.b_file).digest()
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = Pair(self.a_file, self.b_file)
        return _LOADED[key]


_LOADED: dict[bytes, Pair] = {}


def read_files(a_path: str = A_PATH, b_path: str = B_PATH) -> Files:
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return Files(a.read(), b.read())


# --- alignment --------------------------------------------------------------------------------------------------------


@dataclass
class Aligned:
    """Tokens of several texts one after another; a text without tokens takes no bytes."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    a_text: np.ndarray  # text of each token
    b_text: np.ndarray

    @property
    def n_bytes(self) -> int:
        return int(self.a_ends[-1]) if len(self.a_ends) else 0

    def overlap(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Token pairs that share bytes, and how many."""
        return product(byte_incidence(self.a_ends, self.n_bytes), transpose(byte_incidence(self.b_ends, self.n_bytes)))

    def together(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Token pairs that end at the same byte: the product of the incidences of last bytes."""
        return whole_product(one_per_row(self.a_ends - 1, self.n_bytes), transpose(one_per_row(self.b_ends - 1, self.n_bytes)))

    def groups(self, links: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[Csr, Csr]:
        """Tokens x groups of both sides; a group goes from one common end to the next."""
        out = []
        for ends, at in ((self.a_ends, links[0]), (self.b_ends, links[1])):
            closes = np.bincount(at, minlength=len(ends))
            out.append(one_per_row(np.cumsum(closes) - closes, len(at)))
        return out[0], out[1]

    def shared_groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Token pairs in one group."""
        a, b = self.groups(self.together())
        return product(a, transpose(b))


def align(texts: list[bytes], pair: Pair) -> Aligned:
    coded = [pair.encode(t) for t in texts]
    none = (np.empty(0, np.int64),) * 2
    a, b = (np.concatenate([(c or none)[side] for c in coded] or [none[0]]) for side in (0, 1))
    sizes = [np.array([len((c or none)[side]) for c in coded], np.int64) for side in (0, 1)]
    return Aligned(a, b, np.cumsum(pair.a_length[a]), np.cumsum(pair.b_length[b]), *(np.repeat(np.arange(len(texts)), s) for s in sizes))


_LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<int>"


def _digest(texts: list[bytes], pair: Pair) -> tuple[list, ...]:
    found = align(texts, pair)
    links = found.together()
    a_groups, b_groups = (m.indices for m in found.groups(links))
    code = found.a[links[0]] * len(pair.b_bytes) + found.b[links[1]]
    index = np.searchsorted(pair.pairs, code).astype(np.int32)
    text = range(len(texts))
    bounds = [np.searchsorted(owner, np.arange(len(texts) + 1)) for owner in (found.a_text, found.b_text, found.a_text[links[0]])]
    n_a, n_b, n_links = (np.diff(x) for x in bounds)
    written = []
    for i in text:
        (p, q), (r, s) = bounds[0][i:i + 2], bounds[1][i:i + 2]
        line = pair.write_groups(found.a[p:q], found.b[r:s], a_groups[p:q], b_groups[r:s]) if q > p else None
        written.append(hashlib.sha256(line).hexdigest() if line is not None else "")
    lists = [index[x:y] for x, y in zip(bounds[2], bounds[2][1:])]
    firsts = [len(set(a_groups[p:q].tolist())) for p, q in zip(bounds[0], bounds[0][1:])]
    return n_a, n_b, np.array(firsts, np.int64), n_links, written, lists


def linked(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """Per row of docs(doc_id, text): numbers of tokens, groups and links, the groups' digest, and the links as pair numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(files or read_files())

    def run(batches):
        pair = shared.value.load()
        for batch in batches:
            text = batch.column("text")
            for start, end in slices(pc.binary_length(text).fill_null(0).to_pylist(), SLICE_BYTES):
                n_a, n_b, n_groups, n_links, written, lists = _digest(blobs(text.slice(start, end - start)), pair)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[start:end], *(pa.array(n.astype(np.int64)) for n in (n_a, n_b, n_groups, n_links)),
                     pa.array(written, pa.string()), pa.array(lists, pa.list_(pa.int32()))],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _LINKED)


def _by_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``SLICE_LINKS`` links at most, or one row: what is worked out per link stays small."""
    for batch in batches:
        for start, end in slices(batch.column("links").value_lengths().to_pylist(), SLICE_LINKS):
            yield batch.slice(start, end - start)


def _pair_counts(rows: DataFrame, n_pairs: int) -> np.ndarray:
    """Links of each pair over all rows; a task sends one row per pair at most, and so many reach the driver."""

    def count(batches):
        total = np.zeros(n_pairs, np.int64)
        for batch in _by_links(batches):
            total += np.bincount(batch.column("links").flatten().to_numpy(), minlength=n_pairs)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "n"])

    table = rows.select("links").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_pairs, np.int64)
    out[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return out


def _best(counts: np.ndarray, pairs: np.ndarray, n_b: int) -> np.ndarray:
    """Pairs whose count is the highest of their B id."""
    highest = np.zeros(n_b, np.int64)
    np.maximum.at(highest, pairs % n_b, counts)
    return (counts > 0) & (counts == highest[pairs % n_b])


def alignment_digest(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each row of docs(doc_id, text).

    Both tokenizers encode blank + text. Common token ends cut the tokens into groups; a link is a pair of token occurrences that
    end together. ``count_sum`` adds up, over a row's links, how many links of all rows hold the same two ids, ``n_best`` counts those
    no other A id of their B id exceeds. Null and empty texts, and those a tokenizer changes, have no tokens: zeros and an
    empty digest. Repeated rows count as often as they occur. Broadcast are the vocabularies' pairs that can end together
    (some 324,000 for the files given), whatever the number of rows.
    """
    files = files or read_files()
    pair = files.load()
    rows = stage(linked(docs, files), "tokalign-links")
    counts = _pair_counts(rows, len(pair.pairs))
    shared = docs.sparkSession.sparkContext.broadcast((counts, _best(counts, pair.pairs, len(pair.b_bytes)).astype(np.int64)))

    def total(batches):
        for batch in _by_links(batches):
            links = batch.column("links")
            flat, ends = links.flatten().to_numpy(), np.concatenate([[0], np.cumsum(links.value_lengths().to_numpy())])
            sums = []
            for values in shared.value:
                upto = np.concatenate([[0], np.cumsum(values[flat])])
                sums.append(pa.array((upto[ends[1:]] - upto[ends[:-1]]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")), sums[1], sums[0], batch.column("groups_sha256")],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.mapInArrow(total, schema)


def pair_table(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """(a_id, b_id, n_links, best): how often two ids end together in all texts, and whether no other A id does more with that B id."""
    files = files or read_files()
    pair = files.load()
    counts = _pair_counts(linked(docs, files), len(pair.pairs))
    best, seen = _best(counts, pair.pairs, len(pair.b_bytes)), np.flatnonzero(counts)
    a, b = np.divmod(pair.pairs[seen], len(pair.b_bytes))
    spark: SparkSession = docs.sparkSession
    return spark.createDataFrame(pa.table({"a_id": a, "b_id": b, "n_links": counts[seen], "best": best[seen]}))


def token_links(docs: DataFrame, kind: str = "overlap", files: Files | None = None) -> DataFrame:
    """(doc_id, a_at, b_at, a_id, b_id, weight): a row per linked pair of token occurrences, with their places in the text.

    kind ``overlap``: tokens that share bytes, weight their number; ``group``: tokens of one group; ``end``: tokens that end together.
    A product is worked out and sent on in bounded parts.
    """
    if kind not in ("overlap", "group", "end"):
        raise ValueError(f"kind {kind}")
    shared = docs.sparkSession.sparkContext.broadcast(files or read_files())

    def run(batches):
        pair = shared.value.load()
        for batch in batches:
            texts = blobs(batch.column("text"))
            for start, end in slices(map(len, texts), SLICE_BYTES):
                found, ids = align(texts[start:end], pair), batch.column("doc_id")[start:end]
                parts = {"overlap": found.overlap, "group": found.shared_groups, "end": lambda: iter([found.together()])}[kind]()
                for a, b, weight in parts:
                    text = found.a_text[a]
                    first = [np.searchsorted(owner, text) for owner in (found.a_text, found.b_text)]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(text)), *(pa.array(x.astype(np.int64)) for x in (a - first[0], b - first[1], found.a[a], found.b[b], weight))],
                        names=["doc_id", "a_at", "b_at", "a_id", "b_id", "weight"],
                    )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, a_at long, b_at long, a_id long, b_id long, weight long")
