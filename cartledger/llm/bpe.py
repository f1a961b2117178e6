"""BPE encoding and decoding: speculate and verify.

A text falls into chunks at white space, and a worker remembers the chunks it has
met lately.  The words of new chunks are encoded together with many others:

1. *speculate*: greedy longest match proposes tokens;
2. *verify*: one vectorised check over all adjacent pairs of proposed tokens
   tells whether merging by rank would ever join symbols across the border of
   the two.  If it would not, for every pair of a word, the proposal is exactly
   what merging gives, because merges inside one token do not see beyond the
   neighbouring one;
3. only words with a failing pair are merged symbol by symbol, all words at once:
   a round merges in each the pair of lowest rank.

The vocabulary is a public tokenizer file whose path is a parameter; the driver
reads it and ships it to the tasks.  Normalisation and pre-splitting of chunks
that are not plain ASCII are the tokenizers library's own.

Results per text: ``ids`` (little-endian unsigned 32-bit integers, the layout of
flat token files), ``n_tokens`` and ``decoded`` (the tokens joined by blanks, which
is what a tokenizer without a decoder gives).

Defined results: a null is an empty text, which has no ids and decodes to the
empty text; special tokens that stand in a text are encoded as themselves, as
the library does; equal texts get equal ids.  The struct column replaces a
column of its name.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartledger.llm.pieces import PIECE_BYTES, Piece, give_back, pieces

NEVER = np.iinfo(np.int32).max
SHORT_WORD = 64
WORDS_AT_ONCE = 1 << 14
CACHED_CHUNKS = 200_000  # per worker: about as many are remembered, those met lately
# How the vocabulary's format splits plain ASCII, and its end-of-word mark.
_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


class Vocabulary:
    """Tables of a byte-level BPE tokenizer file with an end-of-word mark."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        model = spec["model"]
        # Normalisation and splitting are taken from the library; its own tables of tokens would lie idle.
        bare = {**spec, "model": {**model, "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None}
        self.library = Tokenizer.from_str(json.dumps(bare))
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {content.encode(): number for content, number in special.items()}
        self.special_pattern = re.compile(b"(" + b"|".join(re.escape(c) for c in self.special) + b")") if special else None
        size = max([*self.ids.values(), *special.values()]) + 1
        names = [b""] * size
        for name, number in [*self.ids.items(), *special.items()]:
            names[number] = name.encode()
        self.name_data = np.frombuffer(b"".join(n + b" " for n in names), np.uint8)
        self.name_ends = np.cumsum([len(n) + 1 for n in names])
        self.name_sizes = np.array([len(n) + 1 for n in names])

        self.left, self.right = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        self.made_at = np.full(size, -1, np.int32)  # rank of the merge that makes a token
        self.size = size
        pairs = np.zeros(len(model["merges"]), np.int64)
        self.rank_of: dict[int, int] = {}  # by left * size + right
        self.made = np.zeros(len(model["merges"]), np.int64)
        for rank, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, made = self.ids[a], self.ids[b], self.ids[a + b]
            self.left[made], self.right[made], self.made_at[made] = x, y, rank
            pairs[rank] = x * size + y
            self.rank_of[x * size + y], self.made[rank] = rank, made
        self._place(pairs)
        self.made_ids, self.made = self.made.astype(np.int32), self.made.tolist()
        symbols = {name.removesuffix(self.end): number for name, number in self.ids.items() if len(name.removesuffix(self.end)) == 1}
        self.symbols = np.full((2, max(map(ord, symbols), default=0) + 2), -1, np.int32)  # inside a word, at its end
        for symbol in symbols:
            self.symbols[:, ord(symbol)] = self.ids.get(symbol, -1), self.ids.get(symbol + self.end, -1)
        # Only tokens that merging gives for their own symbols may be proposed.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        for name, number in self.ids.items():
            ends = name.endswith(self.end)
            bare = name[: -len(self.end)] if ends else name
            if bare and (self.made_at[number] < 0 or self.merged(bare, ends) == [number]):
                (self.final if ends else self.inner)[bare] = number
        self.longest = max(map(len, self.final))
        self.reach: dict[str, int] = {}  # the longest inner token by its first three symbols
        for bare in self.inner:
            if len(bare) > 2:
                self.reach[bare[:3]] = max(self.reach.get(bare[:3], 3), len(bare))
        self.letters_alone = not any(content.isalpha() for content in self.special)

    def _place(self, pairs: np.ndarray) -> None:
        """A hash table from pairs to ranks, at most a quarter full: equal places are settled one further on."""
        self.place_bits = max(4, (4 * len(pairs)).bit_length())
        self.pair_keys = np.full(1 << self.place_bits, -1, np.int64)
        self.pair_ranks = np.full(1 << self.place_bits, NEVER, np.int32)
        at, left = self._places(pairs), np.arange(len(pairs))
        while len(left):
            free = self.pair_keys[at] < 0
            self.pair_keys[at[free]] = pairs[left[free]]  # of several that want it one gets it
            own = self.pair_keys[at] == pairs[left]
            self.pair_ranks[at[own]] = left[own]
            left, at = left[~own], (at[~own] + 1) % len(self.pair_keys)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.place_bits)).view(np.int64)

    def start(self, word: str, ends: bool = True) -> list[int]:
        symbols = list(word)
        if ends:
            symbols[-1] += self.end
        return [self.ids[s] for s in symbols if s in self.ids]

    def merged(self, word: str, ends: bool = True) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost first."""
        tokens = self.start(word, ends)
        return self._merged_long(tokens) if len(tokens) > SHORT_WORD else self._merged_short(tokens)

    def _merged_short(self, tokens: list[int]) -> list[int]:
        rank_of, size, made = self.rank_of.get, self.size, self.made
        ranks = [rank_of(a * size + b, NEVER) for a, b in zip(tokens, tokens[1:])]
        while ranks and (low := min(ranks)) != NEVER:
            i = ranks.index(low)
            tokens[i : i + 2] = [made[low]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(tokens[i] * size + tokens[i + 1], NEVER)
            if i:
                ranks[i - 1] = rank_of(tokens[i - 1] * size + tokens[i], NEVER)
        return tokens

    def merged_words(self, words: list[str]) -> list[list[int]]:
        """:meth:`merged` of many words: a round merges in every word its pair of lowest rank, the leftmost first."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > SHORT_WORD):
            out[i] = self._merged_long(self.start(words[i]))
        order = np.argsort(sizes, kind="stable")
        order = order[(sizes[order] > 0) & (sizes[order] <= SHORT_WORD)]
        for width in range(4, SHORT_WORD + 4, 4):  # words of similar length, so that few places are empty
            some = order[(sizes[order] > width - 4) & (sizes[order] <= width)]
            for k in range(0, len(some), WORDS_AT_ONCE):
                self._merge_rows(words, some[k : k + WORDS_AT_ONCE], sizes, width, out)
        return out

    def _merge_rows(self, words: list[str], which: np.ndarray, sizes: np.ndarray, width: int, out: list[list[int]]) -> None:
        if not len(which):
            return
        points = np.frombuffer("".join([words[i] for i in which]).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes[which])
        last = np.zeros(len(points), np.int64)
        last[ends - 1] = 1
        flat = self.symbols[last, np.minimum(points, self.symbols.shape[1] - 1)]
        # Rows of equal width, filled from the left; symbols the vocabulary does not have are passed over.
        row, known = np.repeat(np.arange(len(which)), sizes[which]), flat >= 0
        row, flat = row[known], flat[known]
        counts = np.bincount(row, minlength=len(which))
        at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        tokens = np.full((len(which), width), -1, np.int32)
        tokens[row, at] = flat
        ranks = np.full((len(which), width), NEVER, np.int32)  # of each token with the next; the last place stays empty
        ranks[:, :-1][tokens[:, 1:] >= 0] = self.ranks(tokens[:, :-1][tokens[:, 1:] >= 0], tokens[:, 1:][tokens[:, 1:] >= 0])
        rows = which
        while True:
            here = np.arange(len(rows))
            first = ranks.argmin(1)
            low = ranks[here, first]
            done = low == NEVER
            if done.any():
                for i, own in zip(rows[done].tolist(), tokens[done].tolist()):
                    out[i] = own[: own.index(-1)] if own[-1] < 0 else own
                rows, tokens, ranks, first, low = (v[~done] for v in (rows, tokens, ranks, first, low))
                here = here[: len(rows)]
            if not len(rows):
                return
            # The pair becomes one token; what stands behind it moves up.
            stay = np.ones(tokens.shape, bool)
            stay[here, first + 1] = False
            tokens = tokens[stay].reshape(len(rows), -1)
            tokens[here, first] = self.made_ids[low]
            stay[here, first + 1], stay[here, first] = True, False
            ranks = ranks[stay].reshape(len(rows), -1)
            for spot in (first - 1, first):
                there = np.flatnonzero((spot >= 0) & (spot < tokens.shape[1] - 1))
                spots = spot[there]
                a, b = tokens[there, spots], tokens[there, spots + 1]
                ranks[there, spots] = np.where(b >= 0, self.ranks(a, b), NEVER)

    def _merged_long(self, tokens: list[int]) -> list[int]:
        """The same with a queue, for words whose length makes looking through all pairs slow."""
        n = len(tokens)
        rank = lambda a, b: self.rank_of.get(tokens[a] * self.size + tokens[b], NEVER)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(r, i) for i in range(n - 1) if (r := rank(i, i + 1)) != NEVER]
        heapq.heapify(queue)
        while queue:
            low, i = heapq.heappop(queue)
            j = after[i] if alive[i] else n
            if j >= n or rank(i, j) != low:
                continue
            tokens[i], alive[j] = self.made[low], False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := rank(a, b)) != NEVER:
                    heapq.heappush(queue, (r, a))
        return [t for t, here in zip(tokens, alive) if here]

    def proposed(self, word: str) -> list[int]:
        """Greedy longest match."""
        out, at, n = [], 0, len(word)
        inner, final, reach = self.inner.get, self.final.get, self.reach.get
        while at < n:
            if n - at <= self.longest and (token := final(word[at:])) is not None:
                out.append(token)
                break
            stop = min(at + reach(word[at : at + 3], 2), n - 1)
            while (token := inner(word[at:stop])) is None:
                stop -= 1
            out.append(token)
            at = stop
        return out

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a.astype(np.int64) * self.size + b
        at = self._places(keys)
        found = self.pair_keys[at]
        out = np.where(found == keys, self.pair_ranks[at], NEVER)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            spot = (at[left] + 1) % len(self.pair_keys)
            found, at[left] = self.pair_keys[spot], spot
            own = found == keys[left]
            out[left[own]] = self.pair_ranks[spot[own]]
            left = left[~own & (found >= 0)]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the border between tokens a and b alone.

        Goes back in time from the two finished tokens to the symbols at their
        border: whichever of the two was made last is taken apart.  The border is
        crossed if the pair that touches it has a merge that comes before the
        merges that used up its two parts; of equal ranks the left one is first.
        """
        fine = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int32), b.astype(np.int32)
        x_used, y_used = np.full(len(a), NEVER, np.int32), np.full(len(a), NEVER, np.int32)
        while len(at):
            rank = self.ranks(x, y)
            crossed = (rank < x_used) & (rank <= y_used) & (rank < NEVER)
            fine[at[crossed]] = False
            made_x, made_y = self.made_at[x], self.made_at[y]
            go = ~crossed & ((made_x >= 0) | (made_y >= 0))
            at, x, y, x_used, y_used, made_x, made_y = (v[go] for v in (at, x, y, x_used, y_used, made_x, made_y))
            apart = made_x > made_y
            x_used, y_used = np.where(apart, made_x, x_used), np.where(apart, y_used, made_y)
            x, y = np.where(apart, self.right[x], x), np.where(apart, y, self.left[y])
        return fine

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """Tokens of each word, and how many words had to be merged."""
        out = [self.proposed(w) for w in words]
        flat = np.array([t for tokens in out for t in tokens], np.int32)
        ends = np.cumsum([len(tokens) for tokens in out])
        if len(flat) < 2:
            return out, 0
        inside = np.ones(len(flat) - 1, bool)
        inside[ends[:-1] - 1] = False
        spots = np.flatnonzero(inside)
        wrong = spots[~self.compatible(flat[spots], flat[spots + 1])]
        failed = np.unique(np.searchsorted(ends, wrong, "right"))
        for i, tokens in zip(failed.tolist(), self.merged_words([words[i] for i in failed])):
            out[i] = tokens
        return out, len(failed)

    def split(self, chunk: bytes) -> list[str | int]:
        """Words (as byte symbols) and special tokens of a chunk without white space."""
        if chunk.isalpha() and self.letters_alone:  # ASCII letters are one word
            return [chunk.lower().decode()]
        parts = [chunk] if self.special_pattern is None else self.special_pattern.split(chunk)
        out: list[str | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part.isascii():
                out += self._ascii_words(part.decode())
            else:
                text = self.library.normalizer.normalize_str(part.decode("utf-8", "replace"))
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return out

    def _ascii_words(self, text: str) -> list[str]:
        if text.isprintable():
            return _ASCII_WORDS.findall(text.lower())
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the tokens' names joined by blanks, and their bounds."""
        sizes = self.name_sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(((self.name_ends - self.name_sizes)[ids] - (ends - sizes)).astype(np.int32), sizes)
        at += np.arange(len(at), dtype=np.int32)
        data = self.name_data[at]
        total = np.concatenate([[0], ends])
        keep = np.ones(len(data), bool)
        last = total[bounds[1:][np.diff(bounds) > 0]] - 1
        keep[last] = False  # no blank after the last token
        kept = np.concatenate([[0], np.cumsum(np.diff(total[bounds]) - (np.diff(bounds) > 0))])
        return data[keep], kept


class _Chunks:
    """Chunks by number, and their ids one after the other."""

    def __init__(self):
        self.codes: dict[bytes, int] = {}
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def add(self, new: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        self.codes.update(zip(new, range(len(self.codes), len(self.codes) + len(new))))
        self.flat = np.concatenate([self.flat, ids])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])

    def of(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some chunks, and how many each has."""
        codes = np.fromiter(map(self.codes.__getitem__, chunks), np.int64, len(chunks))
        firsts = self.ends[codes]
        sizes = self.ends[codes + 1] - firsts
        ends = np.cumsum(sizes)
        return self.flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(firsts - (ends - sizes), sizes)], sizes


class Encoder:
    """Encodes pieces of text and remembers the chunks and words it has seen.

    Both are remembered in two halves: when the newer is full it becomes the
    older, whose entries move on as they are met again.  Frequent ones stay.
    """

    def __init__(self, vocabulary: Vocabulary, cached: int | None = None):
        self.vocabulary, self.cached = vocabulary, cached
        self.chunks_seen = self.words_seen = self.words_merged = 0
        self.newer, self.older = _Chunks(), _Chunks()
        self.words: dict[str, bytes] = {}  # the ids as bytes
        self.older_words: dict[str, bytes] = {}

    def _full(self, number: int) -> bool:
        return 2 * number > (CACHED_CHUNKS if self.cached is None else self.cached)

    def _learn(self, new: list[bytes]) -> None:
        if self._full(len(self.words)):
            self.words, self.older_words = {}, self.words
        split = [self.vocabulary.split(chunk) for chunk in new]
        words = self.words
        missing = [w for w in dict.fromkeys(chain.from_iterable(split)) if isinstance(w, str) and w not in words]
        for w in missing:
            if (ids := self.older_words.get(w)) is not None:
                words[w] = ids
        missing = [w for w in missing if w not in words]
        tokens, merged = self.vocabulary.encode_words(missing)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) * 4
        data = np.fromiter(chain.from_iterable(tokens), "<u4").tobytes()
        first = 0
        for w, end in zip(missing, ends.tolist()):
            words[w], first = data[first:end], end
        ids = [b"".join([words[p] if isinstance(p, str) else p.to_bytes(4, "little") for p in parts]) for parts in split]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.newer.add(new, np.frombuffer(b"".join(ids), "<u4"), sizes)
        self.chunks_seen += len(new)
        self.words_seen += len(missing)
        self.words_merged += merged

    def encode(self, piece: Piece) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the bounds of each."""
        ids, bounds, _ = self.encode_sized(piece)
        return ids, bounds

    def encode_sized(self, piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the bounds of each, and how many ids each chunk has."""
        split = [piece.text(i).split() for i in range(len(piece))]
        chunks = [c for own in split for c in own]
        if self._full(len(self.newer.codes)):
            self.newer, self.older = _Chunks(), self.newer
        missing = [c for c in dict.fromkeys(chunks) if c not in self.newer.codes]
        if again := [c for c in missing if c in self.older.codes]:
            self.newer.add(again, *self.older.of(again))
        if new := [c for c in missing if c not in self.older.codes]:
            self._learn(new)
        ids, own = self.newer.of(chunks)
        counts = np.cumsum([0, *map(len, split)])
        return ids, np.concatenate([[0], np.cumsum(own)])[counts], own


@lru_cache(maxsize=2)
def _encoder(text: str, cached: int | None = None) -> Encoder:
    encoder = Encoder(Vocabulary(text), cached)
    give_back()  # reading the file takes more than what is kept of it
    return encoder


ENCODED = T.StructType(
    [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("decoded", T.StringType())]
)


def _strings(data: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = pa.py_buffer(bounds.astype(np.int32).tobytes())
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, offsets, pa.py_buffer(data.tobytes())])


def with_ids(
    documents: DataFrame,
    vocabulary: str,
    text: str = "text",
    into: str = "tokens",
    piece_bytes: int = PIECE_BYTES,
    cached: int | None = None,
) -> DataFrame:
    """Add the struct (ids, n_tokens, decoded) under the vocabulary file at this path.

    Texts are taken ``piece_bytes`` at a time, and ``cached`` chunks remembered: fewer
    of either take less memory and more time.
    """
    with open(vocabulary, encoding="utf-8") as file:
        shipped = documents.sparkSession.sparkContext.broadcast(file.read())  # one file of fixed size

    @F.arrow_udf(ENCODED)
    def encoded(texts: pa.Array) -> pa.Array:
        encoder = _encoder(shipped.value, cached)
        columns: list[list[pa.Array]] = [[], [], []]
        for piece in pieces(texts, piece_bytes):
            ids, bounds = encoder.encode(piece)
            decoded, ends = encoder.vocabulary.decode(ids, bounds)
            columns[0].append(_strings(ids.astype("<u4").view(np.uint8), bounds * 4, pa.binary()))
            columns[1].append(pa.array(np.diff(bounds), pa.int64()))
            columns[2].append(_strings(decoded, ends, pa.string()))
        kinds = [pa.binary(), pa.int64(), pa.string()]
        arrays = [pa.concat_arrays(c) if c else pa.array([], kind) for c, kind in zip(columns, kinds)]
        return pa.StructArray.from_arrays(arrays, ENCODED.names)

    return documents.withColumn(into, encoded(F.col(text)))
