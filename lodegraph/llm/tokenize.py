"""Encoding of a corpus by a byte-level BPE tokenizer: corpus-level merge replay.

Texts are split into words by the tokenizer's pattern in the JVM; a batch reaches Python as Arrow. There the distinct words
not met before are laid end to end, an inverted index holds the positions of each mergeable pair, and the merges are
replayed in rank order: each touches the positions of its own pair and then the pairs of the neighbours only. Ids of
texts are gathered from those of words by Arrow kernels, so the work in Python is by distinct word, not by occurrence.
The words known are kept by worker process across tasks. No shuffle takes place.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import share_file, ship, spread

#: Words a worker process keeps; beyond it starts anew. It only bounds memory.
WORDS_KEPT = 400_000

# White space by Unicode, and the splitting pattern of the tokenizer with it.
SPACE = r"\t-\r \x85\xA0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


class Replay:
    """The merges of a vocabulary, replayed over words."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.first = [0] * 256
        for letter, byte in byte_letters().items():
            self.first[byte] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        #: (left << 20 | right) -> (rank, id)
        self.merges = {vocab[a] << 20 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.by_rank = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, words: list[str]) -> None:
        """Replay all merges over ``words`` together and keep their ids."""
        if not words:
            return
        symbols: list[int] = []
        starts = []
        first = self.first
        for w in words:
            starts.append(len(symbols))
            symbols.extend([first[b] for b in w.encode("utf-8", "surrogatepass")])
            symbols.append(-1)  # words never merge with one another
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges, index = self.merges, {}
        for at in range(n - 1):
            if (a := symbols[at]) >= 0 and (b := symbols[at + 1]) >= 0 and (hit := merges.get(a << 20 | b)):
                index.setdefault(hit[0], []).append(at)
        ranks = list(index)
        heapq.heapify(ranks)
        while ranks:
            rank = heapq.heappop(ranks)
            a, b, new = self.by_rank[rank]
            places = index.pop(rank)
            if a == b:
                places.sort()  # runs of one symbol merge from the left
            for at in places:
                if symbols[at] != a or symbols[right := after[at]] != b:
                    continue  # an earlier merge took one of the two
                symbols[at], symbols[right] = new, -2
                after[at] = then = after[right]
                before[then] = at
                if (s := symbols[then]) >= 0 and (hit := merges.get(new << 20 | s)):
                    if hit[0] not in index:
                        index[hit[0]] = []
                        heapq.heappush(ranks, hit[0])
                    index[hit[0]].append(at)
                if (left := before[at]) >= 0 and (s := symbols[left]) >= 0 and (hit := merges.get(s << 20 | new)):
                    if hit[0] not in index:
                        index[hit[0]] = []
                        heapq.heappush(ranks, hit[0])
                    index[hit[0]].append(left)
        known = self.known
        starts.append(n)
        for w, begin, end in zip(words, starts, starts[1:]):
            known[w] = tuple([s for s in symbols[begin : end - 1] if s >= 0])

    def encode(self, words: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
        """Offsets by text and ids of lists of words (no nulls)."""
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        if len(self.known) + len(distinct) > WORDS_KEPT:
            self.known = {}
        self.learn([w for w in distinct if w not in self.known])
        ids = [self.known[w] for w in distinct]
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        values = np.fromiter((x for t in ids for x in t), np.int32, int(bounds[-1]))
        gathered = pa.ListArray.from_arrays(bounds, values).take(flat.indices)
        ends = np.concatenate([[0], np.cumsum(sizes[flat.indices.to_numpy()], dtype=np.int64)])
        at = words.offsets.to_numpy()
        return ends[at - at[0]], gathered.flatten()

    def lengths(self, words: pa.ListArray) -> np.ndarray:
        """The number of ids of each list of words (no nulls)."""
        flat = words.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        if len(self.known) + len(distinct) > WORDS_KEPT:
            self.known = {}
        self.learn([w for w in distinct if w not in self.known])
        sizes = np.fromiter((len(self.known[w]) for w in distinct), np.int64, len(distinct))
        ends = np.concatenate([[0], np.cumsum(sizes[flat.indices.to_numpy()])])
        at = words.offsets.to_numpy()
        return np.diff(ends[at - at[0]])


@lru_cache(maxsize=2)
def replay_of(path: str) -> Replay:
    return Replay(path)


def _words(df: DataFrame, key: str, text: str) -> DataFrame:
    ship(df.sparkSession)
    words = F.coalesce(F.regexp_extract_all(F.col("text"), F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))
    return spread(df.select(df[key].alias("key"), df[text].alias("text")), "key").select("key", words.alias("words"))


def token_ids(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and ids (array of int) of every row's ``text``, without special tokens.

    A null or empty text gives an empty list; strings that look like special tokens are ordinary text. Whole texts are
    encoded, repeated rows each; other columns are ignored, an empty table gives no rows.
    """
    name = share_file(df.sparkSession, path or tokenizer_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = replay_of(SparkFiles.get(name))
        for batch in batches:
            ends, ids = replay.encode(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids.cast(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return _words(df, key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """``key`` and n_tokens (bigint) of every row's ``text``; 0 for null and empty texts."""
    name = share_file(df.sparkSession, path or tokenizer_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = replay_of(SparkFiles.get(name))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replay.lengths(batch.column(1)), pa.int64())], names=[key, "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return _words(df, key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
