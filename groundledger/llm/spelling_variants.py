"""Spelling variant grouping by a trie of letter-group counts.

A word's vector counts its letters by GROUPS. The trie has a level for each group:
a word goes down by its first count, then by its second, and so on to a leaf. Words
one edit apart differ by one more in one group at most (surplus) and by one less in
one group at most (deficit), so a search goes down by the word's own count, and one
above or below it while its budget of one each lasts. What a leaf holds is narrowed
to the words that share the first or the second half, as one edit leaves one of them
whole, and then compared letter by letter.

The trie is cut into shards. Its upper part, the nodes of more than SHARD_WORDS words
(at most as many on each level as SHARD_WORDS goes into the vocabulary), is known to
all tasks; a word is sent to the shards that its budget reaches in it. A task builds
the trie of one shard after another from their own words and searches it for slabs of
the words sent, depth first, so that it holds a shard and a slab. Words of one and the
same vector that are more than a shard are dealt out by hash, and each such shard is
searched. A pair is found from its longer word, or of equally long ones from the later
one, and counts for both; counts and best neighbours of a word are added up.

Counts of words come first: the runs of a text are counted in byte arrays, and only
counts are shuffled.

Defined cases: null and empty texts have no words; without doc_id there is no hash, so
nothing is deleted; repeated rows count each time; ties of a form go to the smallest
word; a text, and a word, of any length is read whole; no rows give no words; other
columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import release, settle
from .words import _LOWER, U64, _hash_runs, mix, parts, text_bytes

DELETE_EVERY, LEAST_LETTERS, LEAST_COUNT, FORM_RATIO = 199, 6, 5, 5
#: Letters of each level; all others are counted by the last one.
GROUPS = ("e", "i", "n", "a", "r", "t", "s", "o", "hd", "lm", "uc", "gbp", "wvf", "kqxyzj", "éèêçàü")
SHARD_WORDS, SLAB = 8192, 1 << 18
LEVELS = len(GROUPS) + 1
_GROUP_OF = np.full(256, LEVELS - 1, np.int64)
for _k, _letters in enumerate(GROUPS):
    _GROUP_OF[list(_letters.encode("latin-1"))] = _k
_BASE = U64(0xA24BAED4963EE407)
#: Words up to this length are compared as rows of one array.
_NARROW = 64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: One byte's step of CRC-32 (reflected, polynomial 0xEDB88320).
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = np.where(_STEP & 1, (_STEP >> 1) ^ np.uint32(0xEDB88320), _STEP >> 1).astype(np.uint32)


def _runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lowered, row, start and end of the maximal runs of A-Z, a-z and U+00C0 to U+00FF, which are 0xC3 and a byte more."""
    data, at = text_bytes(column)
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first[edge], last[edge - 1] = inside[edge], inside[edge - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return _LOWER[data], np.searchsorted(at, start, "right") - 1, start, end


def _pair_hashes(ids: list[int | None], row: np.ndarray, size: np.ndarray, own: np.ndarray) -> np.ndarray:
    """CRC-32 of `<id>:<word>` from that of the word: the id's part is moved on by the word's bytes."""
    moved = np.array([crc32(f"{k}:".encode()) for k in ids], np.uint32)
    out = np.zeros(len(row), np.uint32)
    order = np.argsort(size, kind="stable")
    bounds = np.searchsorted(size[order], np.arange(1, int(size.max(initial=0)) + 2))
    for n in range(1, len(bounds)):
        moved = _STEP[moved & 0xFF] ^ (moved >> np.uint32(8))
        of = order[bounds[n - 1] : bounds[n]]
        out[of] = moved[row[of]]
        if bounds[n] == len(order):
            break
    return out ^ own


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the texts (doc_id, text); a word may come again."""
    for part in parts(batches):
        data, row, start, end = _runs(part.column("text"))
        if not len(start):
            continue
        _, at, which = np.unique(_hash_runs(data, start, end), return_index=True, return_inverse=True)
        pair, times = np.unique(row * len(at) + which, return_counts=True)
        row, which = np.divmod(pair, len(at))
        a, b = start[at], end[at]
        raw = data.tobytes()
        own = np.fromiter((crc32(raw[x:y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.uint32, len(a))
        ids = part.column("doc_id").to_pylist()
        code = _pair_hashes(ids, row, (b - a)[which], own[which])
        known = np.array([k is not None for k in ids])[row]
        hit = np.flatnonzero(known & (code % DELETE_EVERY == 0))
        cut: dict[str, int] = {}
        for k in hit.tolist():
            w = raw[a[which[k]] : b[which[k]]].decode()
            gone = int(code[k]) % len(w)
            w = w[:gone] + w[gone + 1 :]
            if len(w) >= LEAST_LETTERS:
                cut[w] = cut.get(w, 0) + int(times[k])
        times[hit] = 0
        n = np.bincount(which, times, len(at)).astype(np.int64)
        letters = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
        keep = np.flatnonzero((n > 0) & (letters[b] - letters[a] >= LEAST_LETTERS))
        words = [raw[x:y].decode() for x, y in zip(a[keep].tolist(), b[keep].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*words, *cut], pa.string()), pa.array(np.concatenate([n[keep], np.fromiter(cut.values(), np.int64, len(cut))]))], ["word", "n"]
        )


def word_counts(documents: DataFrame) -> DataFrame:
    """(word, n) of documents(doc_id, text): words of LEAST_LETTERS letters and LEAST_COUNT occurrences."""
    counted = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_COUNT}")


class _Words:
    """Words as one array of letters (every letter is below 256), with hashes of what they begin and end with."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        raw = [w.encode("latin-1") for w in words]
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.flat = np.frombuffer(b"".join(raw), np.uint8)
        of = np.repeat(np.arange(len(raw)), self.size)
        self.vector = np.bincount(of * LEVELS + _GROUP_OF[self.flat], minlength=len(raw) * LEVELS).reshape(-1, LEVELS)
        power = np.ones(int(self.size.max(initial=0)) + 1, U64)
        power[1:] = _BASE
        power = np.multiply.accumulate(power)
        inner = np.arange(len(self.flat)) - self.at[of]
        letter = mix(self.flat.astype(U64) + U64(1))
        zero = np.zeros(1, U64)
        self._front = np.concatenate([zero, np.cumsum(letter * power[inner], dtype=U64)])
        self._back = np.concatenate([zero, np.cumsum(letter * power[self.size[of] - 1 - inner], dtype=U64)])

    def begins(self, which: np.ndarray, many: np.ndarray) -> np.ndarray:
        return self._front[self.at[which] + many] - self._front[self.at[which]]

    def ends(self, which: np.ndarray, many: np.ndarray) -> np.ndarray:
        return self._back[self.at[which + 1]] - self._back[self.at[which + 1] - many]

    def rows(self, which: np.ndarray, width: int) -> np.ndarray:
        """Letters in rows of one width, zeros behind the end."""
        cell = np.arange(width)
        place = np.minimum(self.at[which][:, None] + cell, max(len(self.flat) - 1, 0))
        return np.where(cell < self.size[which][:, None], self.flat[place], 0)


def _one_edit(a: str, b: str) -> bool:
    """Whether b is a with one letter replaced or deleted."""
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a != b and a[k + 1 :] == (b[k + 1 :] if len(a) == len(b) else b[k:])


def _near(a: _Words, i: np.ndarray, b: _Words, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i of a, j of b, as long or one letter shorter) are one edit apart."""
    out = np.zeros(len(i), bool)
    wide = a.size[i] > _NARROW
    for k in np.flatnonzero(wide).tolist():
        out[k] = _one_edit(a.words[i[k]], b.words[j[k]])
    narrow = np.flatnonzero(~wide)
    for first in range(0, len(narrow), SLAB // 4):
        of = narrow[first : first + SLAB // 4]
        width = int(a.size[i[of]].max()) + 1
        x, y = a.rows(i[of], width), b.rows(j[of], width)
        differ = x != y
        replaced = differ.sum(1) == 1
        behind = np.arange(width - 1) >= differ.argmax(1)[:, None]
        deleted = ~((x[:, 1:] != y[:, :-1]) & behind).any(1)
        out[of] = np.where(a.size[i[of]] == b.size[j[of]], replaced, deleted)
    return out


class _Trie:
    """The trie of a shard's words; a level's nodes are numbered in order."""

    def __init__(self, words: list[str]) -> None:
        self.own = _Words(words)
        vector = self.own.vector
        self.order = np.lexsort(vector.T[::-1]) if len(words) else np.zeros(0, np.int64)
        ordered = vector[self.order]
        self.most = int(vector.max(initial=0)) + 3
        node, self.children = np.zeros(len(words), np.int64), []
        for level in range(LEVELS):
            keys, node = np.unique(node * self.most + ordered[:, level], return_inverse=True)
            self.children.append(keys)
        # A leaf's words by their first half and, apart from that, by their second half.
        half = self.own.size[self.order] // 2
        rest = self.own.size[self.order] - half
        self._halves = []
        for key in (self.own.begins(self.order, half), self.own.ends(self.order, rest)):
            key = self._keyed(node, key)
            by = np.argsort(key)
            self._halves.append((key[by], self.order[by]))

    @staticmethod
    def _keyed(leaf: np.ndarray, key: np.ndarray) -> np.ndarray:
        """One number of both; two that coincide by chance are told apart letter by letter."""
        return mix(key ^ mix(leaf.astype(U64)))

    def _reached(self, vector: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word, leaf, whether the leaf's words are one shorter), depth first in slabs."""
        many = len(vector)
        stack = [(0, np.arange(many), np.zeros(many, np.int64), np.zeros(many, np.int8), np.zeros(many, np.int8))]
        while stack:
            level, word, node, surplus, deficit = stack.pop()
            if level == LEVELS:
                fits = surplus <= deficit
                yield word[fits], node[fits], (surplus < deficit)[fits]
                continue
            if len(word) > SLAB:
                middle = len(word) // 2
                stack += [(level, word[s], node[s], surplus[s], deficit[s]) for s in (slice(middle), slice(middle, None))]
                continue
            keys, found = self.children[level], []
            for step in (0, 1, -1):
                of = np.flatnonzero(surplus == 0 if step == 1 else deficit == 0) if step else np.arange(len(word))
                count = vector[word[of], level] + step
                key = node[of] * self.most + np.clip(count, 0, self.most - 1)
                child = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                there = (keys[child] == key) & (count >= 0) & (count < self.most)
                of = of[there]
                found.append((word[of], child[there], surplus[of] + (step == 1), deficit[of] + (step == -1)))
            stack.append((level + 1, *[np.concatenate(x) for x in zip(*found, strict=True)]))

    def near(self, asked: _Words) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (of the words asked, of the trie) one edit apart, each to be found from this side only."""
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if not len(self.order):
            return left[0], right[0]
        place = {w: k for k, w in enumerate(sorted({*asked.words, *self.own.words}))}
        rank, own_rank = (np.array([place[w] for w in x.words], np.int64) for x in (asked, self.own))
        for word, leaf, shorter in self._reached(asked.vector):
            size = asked.size[word] - shorter
            half = size // 2
            for side, (keys, order) in enumerate(self._halves):
                sought = self._keyed(leaf, asked.ends(word, size - half) if side else asked.begins(word, half))
                low, high = np.searchsorted(keys, sought), np.searchsorted(keys, sought, "right")
                times = high - low
                i = np.repeat(np.arange(len(word)), times)
                j = order[np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times) + np.repeat(low, times)]
                w = word[i]
                keep = shorter[i] | (rank[w] > own_rank[j])
                if side:  # not what the first halves have told already
                    keep &= asked.begins(w, half[i]) != self.own.begins(j, half[i])
                w, j = w[keep], j[keep]
                near = _near(asked, w, self.own, j)
                left.append(w[near])
                right.append(j[near])
        return np.concatenate(left), np.concatenate(right)


def _best(asked: list[str], asked_n: np.ndarray, own: list[str], own_n: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """(word, n_near, best_n, best) of the words of both sides of the pairs."""
    words, n = [*asked, *own], np.concatenate([asked_n, own_n])
    by_word = sorted(range(len(words)), key=words.__getitem__)
    place = np.empty(len(words), np.int64)
    place[by_word] = np.arange(len(words))
    order = np.lexsort((place, -n))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    of, to = np.concatenate([i, j + len(asked)]), np.concatenate([j + len(asked), i])
    by = np.lexsort((rank[to], of))
    of, to = of[by], to[by]
    first = np.flatnonzero(np.diff(of, prepend=-1))
    best = to[first]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[k] for k in of[first]], pa.string()),
            pa.array(np.diff(np.append(first, len(of)))),
            pa.array(n[best]),
            pa.array([words[k] for k in best], pa.string()),
        ],
        ["word", "n_near", "best_n", "best"],
    )


def _search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, asked, word, n) come shard by shard, its own words before those asked."""
    shard, own, trie, counts = None, [], None, None
    for batch in batches:
        shards, asks = batch.column("shard").to_numpy(), batch.column("asked").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((shards[1:] != shards[:-1]) | (asks[1:] != asks[:-1])) + 1
        bounds = [0, *edges.tolist(), batch.num_rows]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a == b:
                continue
            if shards[a] != shard:
                shard, own, trie = shards[a], [], None
            piece = batch.slice(a, b - a)
            if not asks[a]:
                own.append(piece)
                continue
            if trie is None:
                words = [w for p in own for w in p.column("word").to_pylist()]
                counts = np.concatenate([np.zeros(0, np.int64), *[p.column("n").to_numpy() for p in own]])
                trie, own = _Trie(words), []
            asked = piece.column("word").to_pylist()
            i, j = trie.near(_Words(asked))
            if len(i):
                yield _best(asked, piece.column("n").to_numpy(), trie.own.words, counts, i, j)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(level, path, n): how many words go by each node, from the root down."""
    for batch in batches:
        vector = _Words(batch.column("word").to_pylist()).vector
        level, path, n = [], [], []
        for depth in range(LEVELS + 1):
            nodes, many = np.unique(vector[:, :depth], axis=0, return_counts=True) if depth else (np.zeros((1, 0), int), np.array([len(vector)]))
            level += [depth] * len(many)
            path += [",".join(map(str, x)) for x in nodes.tolist()]
            n += many.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(level, pa.int32()), pa.array(path, pa.string()), pa.array(n, pa.int64())], ["level", "path", "n"])


def _upper_trie(words: DataFrame, shard_words: int) -> dict[tuple[int, ...], tuple[int, int]]:
    """The shards: path to (number, hashed parts). All paths above them have more words than a shard."""
    nodes = settle(words.select("word").mapInArrow(_paths, "level int, path string, n long").groupBy("level", "path").agg(F.sum("n").alias("n")))
    # A shard is the first node of a path that is small enough, or the leaf: few, as the nodes above it are.
    large = nodes.where(F.col("n") > shard_words)
    above = large.select((F.col("level") + 1).alias("level"), F.col("path").alias("above"))
    parent = F.when(F.col("level") == 1, "").otherwise(F.regexp_replace("path", ",[0-9]+$", ""))
    below = nodes.withColumn("above", parent).join(above, ["level", "above"]).where((F.col("n") <= shard_words) | (F.col("level") == LEVELS))
    root = nodes.where((F.col("level") == 0) & (F.col("n") <= shard_words))
    rows = below.select("path", "n").unionAll(root.select("path", "n")).orderBy("path").collect()
    release(nodes)
    shards, number = {}, 0
    for r in rows:
        pieces = math.ceil(r.n / shard_words)
        shards[tuple(map(int, r.path.split(","))) if r.path else ()] = (number, pieces)
        number += pieces
    return shards


def _send(shards: dict[tuple[int, ...], tuple[int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sends every word (word, n) to its shard, and as asked to the shards that its budget reaches."""
    depth = max(map(len, shards), default=0)
    children: dict[tuple[int, ...], set[int]] = {}
    for path in shards:
        for k in range(len(path)):
            children.setdefault(path[:k], set()).add(path[k])

    def reach(vector: tuple[int, ...]) -> list[tuple[int, ...]]:
        found, stack = [], [((), 0, 0)]
        while stack:
            path, surplus, deficit = stack.pop()
            if path in shards:
                found.append(path)
                continue
            own, below = vector[len(path)], children.get(path, ())
            for count, more, less in ((own, 0, 0), (own + 1, 1, 0), (own - 1, 0, 1)):
                if count in below and surplus + more < 2 and deficit + less < 2:
                    stack.append(((*path, count), surplus + more, deficit + less))
        return found

    def own_shard(vector: tuple[int, ...]) -> tuple[int, ...]:
        return next(vector[:k] for k in range(LEVELS + 1) if vector[:k] in shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("word").to_pylist()
            vector = _Words(words).vector
            # Words with the same upper counts go the same ways.
            upper, which = np.unique(vector[:, :depth], axis=0, return_inverse=True) if depth else (np.zeros((1, 0), int), np.zeros(len(words), int))
            which = which.ravel()
            padded = [(*x, *[0] * (LEVELS - depth)) for x in upper.tolist()]
            ways = [[shards[p][0] + k for p in reach(x) for k in range(shards[p][1])] for x in padded]
            home = [shards[own_shard(x)] for x in padded]
            own = [home[k][0] + (crc32(w.encode()) % home[k][1] if home[k][1] > 1 else 0) for k, w in zip(which.tolist(), words, strict=True)]
            many = np.array([len(x) for x in ways])[which]
            asked = np.repeat(np.arange(len(words)), many)
            to = np.fromiter((s for k in which.tolist() for s in ways[k]), np.int64, int(many.sum()))
            take = pa.array(np.concatenate([np.arange(len(words)), asked]))
            flags = np.concatenate([np.zeros(len(words), bool), np.ones(len(asked), bool)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.array(own, np.int64), to])), pa.array(flags), batch.column("word").take(take), batch.column("n").take(take)],
                ["shard", "asked", "word", "n"],
            )

    return run


def near_words(words: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of words(word, n), distinct words of letters below U+0100, that have near words."""
    shards = _upper_trie(words, shard_words)
    if not shards:
        return words.limit(0).selectExpr("word", "n as n_near", "n as best_n", "word as best")
    sent = words.select("word", "n").mapInArrow(_send(shards), "shard long, asked boolean, word string, n long")
    sent = sent.repartition("shard").sortWithinPartitions("shard", "asked")
    found = sent.mapInArrow(_search_shards, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return found.select("word", "n_near", (-F.col("best.n")).alias("best_n"), F.col("best.word").alias("best"))


def _roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of forms(word, form): the end of the way from form to form of at most so many steps, which double."""
    ways = settle(forms.select("word", F.col("form").alias("root")))
    for _ in range(max(0, math.ceil(math.log2(max(steps, 1))))):
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        before, ways = ways, settle(ways.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
        release(before)
    return ways


def spelling_variants(documents: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of documents(doc_id, text)."""
    words = settle(word_counts(documents))
    near = settle(near_words(words, shard_words))
    joined = words.join(near, "word", "left")
    form = F.col("best_n") >= FORM_RATIO * F.col("n")
    joined = settle(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(form, F.col("best")).alias("form"), F.when(form, F.col("best_n")).alias("form_n"))
    )
    # A form is FORM_RATIO times as frequent as its word, which bounds the way from form to form.
    most = words.agg(F.max("n")).first()[0] or LEAST_COUNT
    roots = _roots(joined.where("form is not null"), 1 + int(math.log(most / LEAST_COUNT) / math.log(FORM_RATIO)))
    out = joined.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
