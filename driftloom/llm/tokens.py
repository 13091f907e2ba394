"""Edit-aware token counts over a segment tree of pre-tokens for each document.

The vocabulary encodes every pre-token by itself, so a text's count is the sum over its pre-tokens.
Special strings of the vocabulary are pre-tokens of one token each, and pre-tokens end where they begin.
A tree's leaves hold runs of pre-tokens (their lengths and counts) and its inner nodes the sums
below. An edit re-encodes from a pre-token boundary shortly before it up to the first boundary after
it where old and new pre-tokens fall into step, replaces what lies between, and updates the sums on
the path of each leaf that changed; nothing else is looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import table

VOCABULARY = "byte_bpe_50k"
LEAF = 32
#: Characters before an edit that a pre-token's end can depend on, one that follows it and contractions of up to three, besides those of a special string that the edit completes.
CONTEXT = 4
CACHE = 500_000


@cache
def pre_tokens():  # noqa: ANN201
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


@cache
def special_strings(vocabulary: str = VOCABULARY):  # noqa: ANN201
    """(pattern of the special strings, or None; the characters of the longest)."""
    import regex

    from driftloom.llm.packing import added_tokens

    known = sorted(added_tokens(vocabulary), key=lambda t: (-len(t), t))
    return (regex.compile("|".join(map(regex.escape, known))), len(known[0])) if known else (None, 0)


def found_pre_tokens(text: str, begin: int = 0, vocabulary: str = VOCABULARY) -> Iterator[str]:
    """The pre-tokens of a text from a boundary on, in order."""
    special, ordinary = special_strings(vocabulary)[0], pre_tokens()
    for stop in special.finditer(text, begin) if special else ():
        yield from (m.group() for m in ordinary.finditer(text, begin, stop.start()))
        yield stop.group()
        begin = stop.end()
    yield from (m.group() for m in ordinary.finditer(text, begin))


@cache
def counter(vocabulary: str = VOCABULARY) -> Callable[[list[str]], list[int]]:
    """The token counts of pre-tokens, looked up in a bounded cache first."""
    from driftloom.llm.packing import encoder

    encode, known = encoder(vocabulary, True), {}

    def counts(words: list[str]) -> list[int]:
        found = list(map(known.get, words))
        if None in found:
            if len(known) > CACHE:
                known.clear()
            for i, n in enumerate(found):
                if n is None:
                    word = words[i]
                    if word not in known:
                        known[word] = len(encode(word))
                    found[i] = known[word]
        return found

    return counts


class TokenTree:
    """A segment tree over a text's pre-tokens: sums of characters and of tokens."""

    def __init__(self, text: str, vocabulary: str = VOCABULARY):
        self.counts, self.vocabulary = counter(vocabulary), vocabulary
        self.context = CONTEXT + max(0, special_strings(vocabulary)[1] - 1)
        self.text = text
        self.encoded = 0
        words = list(found_pre_tokens(text, 0, vocabulary))
        self._build(list(map(len, words)), self.counts(words))

    def _build(self, lengths: list[int], counts: list[int]) -> None:
        cut = range(0, max(1, len(lengths)), LEAF)
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in cut]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (a, b) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = sum(a), sum(b)
        for i in reversed(range(1, self.size)):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character (or the last one), and where its text begins."""
        i, begin = 1, 0
        while i < self.size:
            i *= 2
            if char >= begin + self.chars[i] and self.chars[i + 1]:
                begin, i = begin + self.chars[i], i + 1
        return i - self.size, begin

    def _put(self, leaf: int, lengths: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = lengths, counts
        i = self.size + leaf
        self.chars[i], self.tokens[i] = sum(lengths), sum(counts)
        while i > 1:
            i //= 2
            self._sum(i)

    def edit(self, start: int, length: int, replacement: str) -> None:
        """Replaces ``length`` characters from ``start``; places beyond the text are cut to it."""
        start = min(max(start, 0), len(self.text))
        end = min(start + max(length, 0), len(self.text))
        self.text = self.text[:start] + replacement + self.text[end:]
        shift = len(replacement) - (end - start)
        first, at = self._leaf_at(max(0, start - self.context))
        lengths, counts = self.leaves[first]
        kept = 0
        while kept < len(lengths) and at + lengths[kept] <= start - self.context:
            at += lengths[kept]
            kept += 1
        old, leaf, place = at, first, kept  # where the old pre-tokens are
        new_words, now = [], at
        found = found_pre_tokens(self.text, at, self.vocabulary)
        while True:
            while old < end or old + shift < now:
                if place == len(self.leaves[leaf][0]):
                    if leaf + 1 == len(self.leaves):
                        break
                    leaf, place = leaf + 1, 0
                    continue
                old += self.leaves[leaf][0][place]
                place += 1
            if old >= end and old + shift == now:
                break
            word = next(found, None)
            if word is None:
                break
            new_words.append(word)
            now += len(word)
        self.encoded += now - at
        new_lengths, new_counts = list(map(len, new_words)), self.counts(new_words)
        if leaf == first:
            tail = lengths[place:], counts[place:]
        else:
            tail = [], []
            for i in range(first + 1, leaf):
                if self.leaves[i][0]:
                    self._put(i, [], [])
            self._put(leaf, self.leaves[leaf][0][place:], self.leaves[leaf][1][place:])
        self._put(first, lengths[:kept] + new_lengths + tail[0], counts[:kept] + new_counts + tail[1])
        if len(self.leaves[first][0]) > 16 * LEAF:
            self._build([n for a, _ in self.leaves for n in a], [n for _, b in self.leaves for n in b])


def edited_counts(docs: DataFrame, edits: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_chars, tokens, edited_chars, edited_tokens, encoded_chars of every row.

    ``edits`` is an array of (start, length, text), applied in order, each to the text that the one
    before has left; a null array or a null entry changes nothing. Counts are those of packing. ``encoded_chars`` is what the
    edits made the tree encode anew. A null text is empty; a text of any length is one tree; repeated
    rows, and rows that share an id or have none, give a row each, so there are no ties to break; an
    empty table gives an empty result; columns beyond doc_id, text and what ``edits`` names, whatever
    they are called, are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    names = ["n_chars", "tokens", "edited_chars", "edited_tokens", "encoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, changes in zip(batch.column("text"), batch.column("edits")):
                tree = TokenTree(text.as_py() or "", vocabulary)
                n, tokens = len(tree.text), tree.total
                for change in changes.as_py() or []:
                    if change is not None:
                        tree.edit(change["start"] or 0, change["length"] or 0, change["text"] or "")
                out.append((n, tokens, len(tree.text), tree.total, tree.encoded))
            columns = list(zip(*out)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(to_arrow_type(kind)), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *names]
            )

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), edits.alias("edits"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} long" for n in names))


def revision(text: str = "text") -> Column:
    """Three edits of a text: an insertion after a quarter, a deletion at the half, a replacement after three quarters."""
    n = F.char_length(F.coalesce(text, F.lit(""))).cast("long")

    def edit(start: Column, length: int, words: str) -> Column:
        return F.struct(
            F.floor(start).cast("long").alias("start"), F.lit(length).cast("long").alias("length"), F.lit(words).alias("text")
        )

    return F.array(edit(n * 3 / 4, 12, "revised, 2nd time"), edit(n / 2, 40, ""), edit(n / 4, 0, " [see note 7] "))


def op1_edited_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of the whole ``documents`` table before and after a revision of every text."""
    return edited_counts(table(spark, sf_dir, "documents"), revision())
