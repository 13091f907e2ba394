"""Lexical retrieval packing: windows filled with BM25 neighbours of a seed document.

Terms are token ids. Document frequencies, the number of documents and their mean length are counted
over all documents first. Documents are then dealt by content: in order of the two terms of greatest
BM25 weight, and this order is cut into spans of even size for the shuffle, where a pair of terms
with more than its share of all tokens is spread over spans of its own. Within a partition the
documents come in that order, and each run of some million tokens is a shard with an inverted
index of its own, so a document's lexical neighbours are in its shard.

In a shard, documents become seeds in order. A seed's tokens fill windows of 1,024; its last,
unfinished window is filled from the unused documents in order of their BM25 score for all of the
seed's terms (documents that share none come last), each as far as it fits: what is cut off stays
unused and is a seed or a neighbour later. What a shard can't fill goes on into the next shard of
the partition; only a partition's last window is split into sequences of powers of two. So there is
no padding at all.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import checkpoint, partitions, table

WINDOW = 1024
END = 0
#: Tokens and documents of a shard: the last document is the one that reaches either.
SHARD_TOKENS, SHARD_ROWS = 1 << 20, 4096
K1, B = 1.2, 0.75
VOCABULARY = "byte_bpe_50k"
#: Seeds that are scored together; a term that one in so many of a shard's documents have is a column of a matrix, others have lists.
SEEDS, COMMON = 64, 8
#: Spans of the order by content for each shuffle partition.
SPANS = 4
Piece = tuple[object, int, int, int, int, int, int]


@cache
def ranks(vocabulary: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@cache
def added_tokens(vocabulary: str) -> dict[str, int]:
    """The special strings that the tokenizer file knows, with their ids."""
    return {t.content: i for i, t in _tokenizer(vocabulary, True).get_added_tokens_decoder().items()}


@cache
def encoder(vocabulary: str = VOCABULARY, special: bool = False) -> Callable[[str], np.ndarray]:
    """The ids of a text by the public vocabulary of that name; with ``special``, its special strings have their own ids.

    The ranks of the vocabulary give the same ids as its tokenizer file at several times the speed;
    texts that the quicker library gives up on go through the tokenizer file.
    """
    import public_tokenizers
    import tiktoken

    known = added_tokens(vocabulary) if special else {}
    quick = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(vocabulary), special_tokens=known)

    def encode(text: str) -> np.ndarray:
        try:
            return quick.encode_to_numpy(text, allowed_special="all", disallowed_special=())
        except BaseException as stopped:  # the library panics on some very long runs of spaces
            if type(stopped).__name__ != "PanicException" and not isinstance(stopped, ValueError):
                raise
            return np.array(_tokenizer(vocabulary, special).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


@cache
def _tokenizer(vocabulary: str, special: bool):  # noqa: ANN202
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    tokenizer.encode_special_tokens = not special
    return tokenizer


def size_of(vocabulary: str = VOCABULARY) -> int:
    return max(*ranks(vocabulary).values(), *added_tokens(vocabulary).values()) + 1


def terms_of(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, in order, and how often each comes."""
    s = np.sort(ids, kind="stable")  # by radix for 16 bits
    begin = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    return s[begin], np.diff(np.r_[begin, len(s)])


class Statistics:
    """The number of documents, their mean length and each term's inverse document frequency, over all documents."""

    def __init__(self, documents: int, tokens: int, df: np.ndarray):
        self.mean = max(1.0, tokens / max(1, documents))
        self.df = df
        self.idf = np.log1p((documents - df + 0.5) / (df + 0.5))

    def weights(self, terms: np.ndarray, counts: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The BM25 weight of terms that come so often in documents of such lengths."""
        return self.idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / self.mean))

    def places(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray) -> list[tuple[int, int]]:
        """For each document the two terms of greatest weight of those that another document has too; ties go to the smaller term, 0 where there is none."""
        sizes = [len(t) for t in terms]
        term, count = np.concatenate(terms), np.concatenate(counts)
        weight = self.weights(term, count, np.repeat(lengths, sizes))
        weight[self.df[term] < 2] = -1.0
        out, at = [], 0
        for t, n in zip(terms, sizes):
            w, best = weight[at : at + n], []
            for _ in range(2):
                i = int(w.argmax())
                best.append(int(t[i]) if w[i] >= 0 else 0)
                w[i] = -1.0
            out.append((best[0], best[1]))
            at += n
        return out


class Index:
    """An inverted index with BM25 weights over the documents of a shard."""

    def __init__(self, terms: list[np.ndarray], counts: list[np.ndarray], lengths: np.ndarray, statistics: Statistics):
        self.terms, self.n = terms, len(terms)
        sizes = [len(t) for t in terms]
        term, doc = np.concatenate(terms), np.repeat(np.arange(self.n), sizes)
        weight = statistics.weights(term, np.concatenate(counts), np.repeat(lengths, sizes))
        here = np.bincount(term, minlength=len(statistics.df))
        common = np.flatnonzero(here * COMMON >= max(2 * COMMON, self.n))
        self.column = np.full(len(here), -1)
        self.column[common] = np.arange(len(common))
        dense = self.column[term] >= 0
        self.matrix = np.zeros((self.n, len(common)))
        self.matrix[doc[dense], self.column[term[dense]]] = weight[dense]
        order = np.argsort(term[~dense], kind="stable")
        self.doc, self.weight = doc[~dense][order], weight[~dense][order]
        self.begin = np.r_[0, np.cumsum(np.bincount(term[~dense], minlength=len(here)))]
        self.block, self.first = np.zeros((0, self.n)), 0

    def scores(self, seed: int) -> np.ndarray:
        """The BM25 score of every document of the shard for all of the seed's terms."""
        if not self.first <= seed < self.first + len(self.block):
            self.first = seed
            asks = (self.matrix[seed : seed + SEEDS] > 0).astype(np.float64)
            self.block = asks @ self.matrix.T
        terms = self.terms[seed].astype(np.int64)
        terms = terms[self.column[terms] < 0]
        first, count = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        at = np.arange(count.sum()) + np.repeat(first - np.cumsum(count) + count, count)
        return self.block[seed - self.first] + np.bincount(self.doc[at], self.weight[at], minlength=self.n)


class Packer:
    """Fills windows shard after shard; ``parts`` is the window that is not full yet."""

    def __init__(self, statistics: Statistics, window: int, first_sequence: int):
        self.statistics, self.window, self.sequence = statistics, window, first_sequence
        self.parts: list[tuple[object, np.ndarray, int, int]] = []
        self.filled = 0

    def shard(self, names: list, docs: list[np.ndarray], terms: list[np.ndarray], counts: list[np.ndarray]) -> Iterator[Piece]:
        """The pieces (name, start, length, crc, tokens, sequence, offset) of the windows that become full; no array is empty."""
        length, start = np.array([len(d) for d in docs]), np.zeros(len(docs), np.int64)
        index = Index(terms, counts, length, self.statistics)
        unused, upcoming = np.ones(len(docs), bool), list(range(len(docs)))

        def put(doc: int) -> None:
            take = int(min(self.window - self.filled, length[doc] - start[doc]))
            self.parts.append((names[doc], docs[doc], int(start[doc]), take))
            start[doc] += take
            self.filled += take
            unused[doc] = start[doc] < length[doc]

        while upcoming:
            seed = heapq.heappop(upcoming)
            while unused[seed]:
                put(seed)
                if self.filled == self.window:
                    yield from self.full()
            if self.filled:
                for other in neighbours(index, seed, unused, upcoming):
                    put(other)
                    if self.filled == self.window:
                        yield from self.full()
                        break

    def full(self, room: int | None = None) -> Iterator[Piece]:
        offset = 0
        for name, ids, begin, n in self.parts:
            crc = zlib.crc32(ids[begin : begin + n].astype("<u4").tobytes())
            yield name, begin, n, crc, len(ids), self.sequence, offset
            offset += n
        self.parts, self.filled, self.sequence = [], 0, self.sequence + 1

    def rest(self) -> Iterator[Piece]:
        """The last tokens, cut into sequences whose lengths are the powers of two of their sum."""
        left, self.parts, total = self.parts[::-1], [], self.filled
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            while room:
                name, ids, begin, n = left.pop()
                take = min(n, room)
                self.parts.append((name, ids, begin, take))
                room -= take
                if take < n:
                    left.append((name, ids, begin + take, n - take))
            yield from self.full()


def neighbours(index: Index, seed: int, unused: np.ndarray, upcoming: list[int]) -> Iterator[int]:
    """The unused documents by score, ties in order, then those that share no term, in order; callers use up each before the next."""
    scores = np.where(unused, index.scores(seed), 0.0)
    for many in (8, len(scores)):
        top = np.argpartition(-scores, many - 1)[:many] if many < len(scores) else np.arange(len(scores))
        for other in top[np.lexsort((top, -scores[top]))]:
            if scores[other] > 0 and unused[other]:
                yield int(other)
    while upcoming:
        if unused[upcoming[0]]:
            yield upcoming[0]
        if upcoming and not unused[upcoming[0]]:
            heapq.heappop(upcoming)


def _unsigned(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, h (a hash of the text), and as bytes its token ids with the end id, the terms (distinct ids) and their counts, of every row.

    Counts are of one byte where they fit.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    unsigned = _unsigned(size_of(vocabulary))
    names = ["doc_id", "h", "ids", "terms", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, True)
        for batch in batches:
            ids, terms, counts = [], [], []
            for text in batch.column("text"):
                found = np.append(encode(text.as_py() or ""), END).astype(unsigned)
                distinct, times = terms_of(found)
                ids.append(found.tobytes())
                terms.append(distinct.tobytes())
                counts.append(times.astype(np.uint8 if times.max() < 256 else np.uint32).tobytes())
            columns = [batch.column("doc_id"), batch.column("h"), *(pa.array(x, pa.binary()) for x in (ids, terms, counts))]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, h long, ids binary, terms binary, counts binary")


def arrays(column: pa.Array, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def counts_of(column: pa.Array, terms: list[np.ndarray]) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint8 if len(x.as_buffer()) == len(t) else np.uint32) for x, t in zip(column, terms)]


def statistics_of(rows: DataFrame, vocabulary: str = VOCABULARY) -> Statistics:
    """Counted over all ``encoded`` rows; what comes to the driver is a row for each term of the vocabulary at most."""
    size = size_of(vocabulary)
    unsigned = _unsigned(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, documents, tokens = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for terms in arrays(batch.column("terms"), unsigned):
                df[terms] += 1
            documents += batch.num_rows
            tokens += int(batch.column("size").to_numpy().sum())
        term = np.r_[-2, -1, np.flatnonzero(df)]
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(np.r_[documents, tokens, df[df > 0]])], ["term", "n"])

    each = rows.select("terms", (F.octet_length("ids") / unsigned(0).itemsize).cast("long").alias("size"))
    found = dict(map(tuple, each.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect()))
    df = np.zeros(size, np.int64)
    for t, n in found.items():
        if t >= 0:
            df[t] = n
    return Statistics(found.get(-2, 0), found.get(-1, 0), df)


def placed(rows: DataFrame, statistics: Statistics, spans: int) -> DataFrame:
    """``rows`` with one, two (the terms they are placed by), span and size.

    The driver gets the sum of tokens for each first term, and of each pair of terms that holds more
    than a quarter of a span (at most four for each span), and lays them out by number; a row stands
    in its first term's share by a hash of the second, in a large pair's share by a hash of its own.
    """
    unsigned = _unsigned(len(statistics.df))
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields]

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column("size").to_numpy()
            distinct = arrays(batch.column("terms"), unsigned)
            found = statistics.places(distinct, counts_of(batch.column("counts"), distinct), size)
            one, two = np.array(found, np.int32).T
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(one), pa.array(two)], [*batch.schema.names, "one", "two"])

    in_tokens = (F.octet_length("ids") / unsigned(0).itemsize).cast("long").alias("size")
    found = rows.select("terms", "counts", in_tokens).mapInArrow(terms, "terms binary, counts binary, size long, one int, two int")
    pairs = checkpoint(found.groupBy("one", "two").agg(F.sum("size").alias("size")))
    total = pairs.agg(F.sum("size")).first()[0] or 0
    heavy = {(a, b): n for a, b, n in pairs.where(F.col("size") > max(1, total // (4 * spans))).collect()}
    light = {a: n for a, n in pairs.groupBy("one").agg(F.sum("size")).collect()}  # a row for each term at most
    for (a, _), n in heavy.items():
        light[a] -= n
    layout, at = {}, 0
    for a, b in sorted([*((a, -1) for a in light), *heavy]):
        size = heavy[(a, b)] if b >= 0 else light[a]
        layout[(a, b)] = at, size
        at += size

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in terms(batches):
            out = []
            for one, two, h, own in zip(*(batch.column(c).to_pylist() for c in ("one", "two", "h", "own"))):
                large = (one, two) in heavy
                first, size = layout[(one, two if large else -1)]
                share = (h ^ own) if large else two * 0x9E3779B97F4A7C15
                share = ((share * 0xD6E8FEB86659FD93) >> 20 & 0xFFFFFFFF) / 2**32
                out.append(min(spans - 1, int((first + size * share) * spans / max(1, total))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "span"])

    own = rows.select("*", F.xxhash64("doc_id", "h").alias("own"), in_tokens)
    return own.mapInArrow(dealt, ", ".join([*fields, "own long", "size long", "one int", "two int", "span int"])).drop("own")


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    Null and empty texts are the end id alone. Rows that repeat, or share a doc_id, are packed each
    by itself, equal ones in any order; a null doc_id is kept. A long text is cut over many windows.
    Documents of equal score follow one another in order of their place. An empty table gives an
    empty result; only doc_id and text are read.
    """
    spark = docs.sparkSession
    rows = checkpoint(encoded(docs, vocabulary))
    statistics = statistics_of(rows, vocabulary)
    n, field = partitions(spark), docs.schema["doc_id"].dataType
    unsigned = _unsigned(len(statistics.df))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, tokens = None, ([], [], [], []), 0

        def table_of(pieces: Iterator[Piece]) -> pa.RecordBatch:
            columns = list(zip(*pieces)) or [()] * len(names)
            kinds = [arrow, *[pa.int64()] * 6]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            columns = [batch.column("doc_id"), batch.column("span")]
            columns += [arrays(batch.column(c), unsigned) for c in ("ids", "terms")]
            columns.append(counts_of(batch.column("counts"), columns[-1]))
            for doc_id, span, *parts in zip(*columns):
                packer = packer or Packer(statistics, window, span.as_py() << 32)
                for to, x in zip(held, (doc_id.as_py(), *parts)):
                    to.append(x)
                tokens += len(parts[0])
                if tokens >= shard_tokens or len(held[0]) >= SHARD_ROWS:
                    yield table_of(packer.shard(*held))
                    held, tokens = ([], [], [], []), 0
        if held[0]:
            yield table_of(packer.shard(*held))
        if packer:
            yield table_of(packer.rest())

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(field)
    dealt = placed(rows, statistics, SPANS * n).select("doc_id", "h", "ids", "terms", "counts", "one", "two", "span")
    dealt = dealt.repartition(n, "span").sortWithinPartitions("span", "one", "two", "doc_id", "h")
    return dealt.mapInArrow(run, f"doc_id {field.simpleString()}, " + ", ".join(f"{c} long" for c in names[1:]))


def op2_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table packed into sequences of at most 1,024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
