"""Language-model scores from a weighted backoff automaton over words.

States are contexts of up to two words, arcs all n-grams of the training texts
with their log-probabilities, and a failure arc leads from a context to the one
without its first word, at the cost of the backoff weight; at the root every
word of the training texts has a probability, and all others share that of the
unknown word. Counts are smoothed by absolute discounting.

No n-gram is left out, whatever the size of the corpus. The texts are cut into
lots of about LOT_TOKENS tokens. A lot asks for each of its distinct n-grams
once, in blobs by bucket of the key; a bucket adds up the counts of all lots and
answers every blob in its order. So a frequent n-gram costs one entry a lot, and
no key is hot. Words and pairs are asked for first, then triples, so that only
one of the two shuffles is on disk at a time. A last round adds up the arcs of
every context, each sent by the one lot that its bucket chose, and answers the
contexts whose failure arcs held-out texts take. N-grams are known by 64-bit hashes.

Defined cases: null and empty texts are one end token; without any training
token every token is unknown; a row without doc_id is not held out; repeated
rows count and score once each; equal n-grams of any number of texts are one
entry a lot; a long text is a lot of its own; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import release, settle
from .words import _MULT, U64, find_words, mix, parts

DISCOUNT = 0.7
FOLDS, HELD_OUT = 5, 1
#: The end of a text is a token; it is also the context that a text begins in.
END = U64(0x0F0E0D0C0B0A0908)
#: Tokens of a lot, and tokens for each bucket; both bound the arrays of a task.
LOT_TOKENS, BUCKET_TOKENS = 1 << 18, 1 << 20
#: Parts of the lots that are walked one after the other.
PARTS = 4
#: Buckets of triples are numbered from here on.
DEEP = 1 << 30


def held_out(ids: pa.Array) -> np.ndarray:
    return np.array([x is not None and crc32(str(x).encode()) % FOLDS == HELD_OUT for x in ids.to_pylist()], bool)


def _tokens(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text with an end before and after it, and the offsets of the texts."""
    words = find_words(part.column("text"))
    after = np.insert(words.hash, words.off[1:], END)
    off = words.off + np.arange(len(words.off))
    return np.insert(after, off[:-1], END), off + np.arange(len(off))


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each lot of texts: their ids and folds, the lot's distinct words and their numbers in the texts."""
    kept: list[tuple] = []

    def lot() -> pa.RecordBatch:
        ids, held, size, tokens = (list(x) for x in zip(*kept, strict=True))
        kept.clear()
        ids = pa.concat_arrays(ids)
        words, number = np.unique(np.concatenate(tokens), return_inverse=True)
        held, size = np.concatenate(held), np.concatenate(size).astype(np.int64)
        many = len(number) - len(ids)
        train = int(((size - 1) * ~held).sum())
        blobs = (held.tobytes(), _packed(size), _packed(words, ordered=True), _packed(number.astype(np.int64)))
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([many], pa.int64()), pa.array([train], pa.int64())]
            + [_binary([x]) for x in blobs],
            ["ids", "tokens", "train", "held", "size", "words", "number"],
        )

    for part in parts(batches):
        tokens, off = _tokens(part)
        kept.append((part.column("doc_id").cast(pa.int64()), held_out(part.column("doc_id")), np.diff(off), tokens))
        if sum(len(x[3]) for x in kept) >= LOT_TOKENS:
            yield lot()
    if kept:
        yield lot()


class Lot:
    """The distinct n-grams of a lot in the order words, pairs, triples, and the tokens' places among them."""

    def __init__(self, row: dict) -> None:
        self.words, size, number = _read(row["words"], U64, ordered=True), _read(row["size"], np.int64), _read(row["number"], np.int64)
        self.held = np.frombuffer(row["held"], bool)
        self.many = len(self.words)
        token = np.ones(len(number), bool)
        token[np.cumsum(size) - size] = False
        at = np.flatnonzero(token)
        #: Of every token: its text, its word, the word before, whether two tokens are before.
        self.text = np.repeat(np.arange(len(size)), size - 1)
        self.word, self.before = number[at], number[at - 1]
        self.deep = np.flatnonzero(token[at - 1])
        pairs, self.pair = np.unique(self.before * self.many + self.word, return_inverse=True)
        self.left, self.right = pairs // self.many, pairs % self.many
        self.contexts = np.concatenate([self.words, mix(self.words[self.left] * _MULT + self.words[self.right] + U64(2))])

    def with_triples(self) -> Lot:
        triples, first, self.triple = np.unique(
            self.pair[self.deep - 1] * self.many + self.word[self.deep], return_index=True, return_inverse=True
        )
        #: The first and the last pair of every triple.
        self.head, self.tail = triples // self.many, self.pair[self.deep[first]]
        self.triples = mix(self.contexts[self.many :][self.head] * _MULT + self.words[triples % self.many] + U64(3))
        return self

    def _counts(self, at: np.ndarray, aside: np.ndarray, many: int) -> np.ndarray:
        """Twice the count in the lot's training texts, and 1 if a held-out text has it."""
        n = 2 * np.bincount(at[~aside], minlength=many)
        n[at[aside]] += 1 - n[at[aside]] % 2
        return n

    def context_counts(self) -> np.ndarray:
        held = self.held[self.text]
        words = self._counts(self.word, held, self.many)
        # A text begins in the state of its end token.
        if self.held.any():
            words[np.searchsorted(self.words, END)] |= 1
        return np.concatenate([words, self._counts(self.pair, held, len(self.left))])

    def triple_counts(self) -> np.ndarray:
        return self._counts(self.triple, self.held[self.text][self.deep], len(self.head))


def _by_bucket(keys: np.ndarray, buckets: int, words: int = 0) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket and key, and (bucket, from, to) of the runs in it; the first keys have buckets of their own."""
    bucket = ((keys >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
    few = -(-buckets // 8)
    bucket[:words] = buckets + bucket[:words] % few
    order = np.lexsort((keys, bucket))
    edge = np.searchsorted(bucket[order], np.arange(buckets + few + 1))
    return order, [(b, int(edge[b]), int(edge[b + 1])) for b in range(buckets + few) if edge[b] < edge[b + 1]]


def _packed(values: np.ndarray, ordered: bool = False) -> bytes:
    """Values of 8 bytes (as differences, if they are ordered) by planes of bytes, compressed."""
    raw = np.diff(values, prepend=values.dtype.type(0)) if ordered else values
    planes = np.ascontiguousarray(raw.view(np.uint8).reshape(-1, 8).T)
    return len(values).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _read(blob: bytes, kind: type, ordered: bool = False) -> np.ndarray:
    many = int.from_bytes(blob[:4], "little")
    planes = np.frombuffer(pa.decompress(blob[4:], decompressed_size=8 * many, codec="zstd", asbytes=True), np.uint8)
    value = np.ascontiguousarray(planes.reshape(8, many).T).view(kind)[:, 0]
    return np.cumsum(value, dtype=kind) if ordered else value


def _unpacked(column: pa.ChunkedArray, kind: type, ordered: bool = False) -> list[np.ndarray]:
    return [_read(blob, kind, ordered) for blob in column.to_pylist()]


def _binary(blobs: list[bytes]) -> pa.Array:
    return pa.array(blobs, pa.binary())


def _joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *arrays])


def _counted(table: pa.Table) -> pa.Table:
    """Answers of one bucket to all lots: four times the count of each n-gram, 2 if a held-out text has it, 1 for the lot that owns it."""
    lists = _unpacked(table.column("keys"), U64, ordered=True)
    size = np.array([len(x) for x in lists])
    keys, n = np.concatenate(lists), np.concatenate(_unpacked(table.column("n"), np.int64))
    value, first, back = np.unique(keys, return_index=True, return_inverse=True)
    total, held = np.zeros(len(value), np.int64), np.zeros(len(value), bool)
    np.add.at(total, back, n >> 1)
    held[back[n & 1 == 1]] = True
    answer = (4 * total + 2 * held)[back]
    answer[first] += 1
    known = np.zeros(len(size), np.int64)
    known[0] = (total > 0).sum()
    start = np.cumsum(size) - size
    return pa.table(
        [table.column("lot"), table.column("bucket"), pa.array(known), _binary([_packed(answer[a : a + k]) for a, k in zip(start, size, strict=True)])],
        ["lot", "bucket", "known", "answer"],
    )


def _weighed(table: pa.Table) -> pa.Table:
    """Answers of one bucket: arcs of each asked context and the sum of their lower probabilities."""
    lists = _unpacked(table.column("keys"), U64, ordered=True)
    size = np.array([len(x) for x in lists])
    arcs, lower = (np.concatenate(_unpacked(table.column(c), t)) for c, t in (("arcs", np.int64), ("lower", float)))
    value, back = np.unique(np.concatenate(lists), return_inverse=True)
    many = np.bincount(back, arcs >> 1, len(value)).astype(np.int64)[back]
    sums = np.bincount(back, lower, len(value))[back]
    asked = arcs & 1 == 1
    cut = [slice(a, a + k) for a, k in zip(np.cumsum(size) - size, size, strict=True)]
    return pa.table(
        [
            table.column("lot"),
            table.column("bucket"),
            _binary([_packed(many[c][asked[c]]) for c in cut]),
            _binary([_packed(sums[c][asked[c]]) for c in cut]),
        ],
        ["lot", "bucket", "arcs", "lower"],
    )


def lm_scores(documents: DataFrame) -> DataFrame:
    """Base and model scores of every row of documents(doc_id, text), learning from those not held out."""
    lots = settle(
        documents.select("doc_id", "text")
        .mapInArrow(_lots, "ids array<long>, tokens long, train long, held binary, size binary, words binary, number binary")
        .withColumn("lot", F.monotonically_increasing_id())
    )
    zero = F.lit(0)
    tokens, total = lots.agg(F.coalesce(F.sum("tokens"), zero), F.coalesce(F.sum("train"), zero)).first()
    buckets = max(8, -(-tokens // BUCKET_TOKENS))

    def asked(deep: bool):
        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(batch.num_rows):
                    row = batch.slice(k, 1).to_pylist()[0]
                    lot = Lot(row)
                    if deep:
                        keys, n = lot.with_triples().triples, lot.triple_counts()
                    else:
                        keys, n = lot.contexts, lot.context_counts()
                    order, runs = _by_bucket(keys, buckets, 0 if deep else lot.many)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["lot"]] * len(runs), pa.int64()),
                            pa.array([b + deep * DEEP for b, _, _ in runs], pa.int32()),
                            _binary([_packed(keys[order[x:y]], ordered=True) for _, x, y in runs]),
                            _binary([_packed(n[order[x:y]]) for _, x, y in runs]),
                        ],
                        ["lot", "bucket", "keys", "n"],
                    )

        return (
            lots.mapInArrow(ask, "lot long, bucket int, keys binary, n binary")
            .groupBy("bucket")
            .applyInArrow(_counted, "lot long, bucket int, known long, answer binary")
        )

    shallow = settle(asked(False))
    deep = settle(asked(True))
    answers = shallow.unionAll(deep)
    distinct = shallow.where(F.col("bucket") >= buckets).agg(F.coalesce(F.sum("known"), zero)).first()[0]
    smooth = total + 0.5 * (distinct + 1)
    unknown = DISCOUNT * distinct / total if total else 1.0
    first = "lot long, bucket int, keys binary, arcs binary, lower binary, ids array<long>, held binary, many binary, score binary, text binary, place binary, seen binary"
    names = [c.split()[0] for c in first.split(", ")]

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        """A lot's sums over known arcs, the failure arcs still to be weighed, and what it adds to its contexts."""
        row = left.to_pylist()[0]
        lot = Lot(row).with_triples()
        order = np.concatenate([_by_bucket(lot.contexts, buckets, lot.many)[0], len(lot.contexts) + _by_bucket(lot.triples, buckets)[0]])
        answer = np.zeros(len(order), np.int64)
        answer[order] = np.concatenate(_unpacked(right.sort_by("bucket").column("answer"), np.int64))
        n, owned = answer >> 2, answer & 1 == 1
        wanted = (answer & 2 == 2)[: len(lot.contexts)]
        n1, n2, n3 = np.split(n.astype(float), [lot.many, lot.many + len(lot.left)])
        own2, own3 = np.split(owned, [lot.many, lot.many + len(lot.left)])[1:]
        p1 = np.where(n1 > 0, (n1 - DISCOUNT) / max(total, 1), unknown)
        p2 = (n2 - DISCOUNT) / np.maximum(n1[lot.left], 1)
        p3 = (n3 - DISCOUNT) / np.maximum(n2[lot.head], 1)

        tokens = np.arange(len(lot.word))
        deep = np.zeros(len(tokens), bool)
        deep[lot.deep] = True
        triple = np.zeros(len(tokens), np.int64)
        triple[lot.deep] = lot.triple
        hit3 = deep.copy()
        hit3[lot.deep] = n3[lot.triple] > 0
        hit2 = ~hit3 & (n2[lot.pair] > 0)
        root = ~hit3 & ~hit2
        p = np.ones(len(tokens))
        p[hit3] = p3[triple[hit3]]
        p[hit2] = p2[lot.pair[hit2]]
        p[root] = p1[lot.word[root]]
        # Failure arcs: from a pair that is a state, and from a word that is one.
        pair = np.flatnonzero(deep & ~hit3)
        pair = pair[n2[lot.pair[pair - 1]] > 0]
        word = np.flatnonzero(root & (n1[lot.before] > 0))
        step = np.concatenate([lot.many + lot.pair[pair - 1], lot.before[word]])
        texts = len(lot.held)

        arcs = np.zeros(len(lot.contexts))
        lower = np.zeros(len(lot.contexts))
        two, three = own2 & (n2 > 0), own3 & (n3 > 0)
        for at, value in ((lot.left[two], p1[lot.right[two]]), (lot.many + lot.head[three], p2[lot.tail[three]])):
            arcs += np.bincount(at, minlength=len(arcs))
            lower += np.bincount(at, value, len(arcs))
        asked = np.zeros(len(arcs), bool)
        asked[step] = True
        # Only contexts that a held-out text has can be asked for.
        sent = np.flatnonzero(asked | (wanted & (arcs > 0)))
        sort, runs = _by_bucket(lot.contexts[sent], buckets)
        sent = sent[sort]
        place = np.full(len(arcs), -1, np.int64)
        place[sent[asked[sent]]] = np.arange(int(asked.sum()))
        many = np.stack([np.bincount(lot.text, minlength=texts), np.bincount(lot.text, n1[lot.word] > 0, texts).astype(np.int64)])
        base = np.bincount(lot.text, np.log10((n1 + 0.5) / smooth)[lot.word], texts)
        score = np.bincount(lot.text, np.log10(p), texts)
        steps = np.concatenate([lot.text[pair], lot.text[word]]), place[step], n[sent[asked[sent]]]

        cut = [sent[x:y] for _, x, y in runs]
        k = len(cut)
        blobs = [
            [_packed(lot.contexts[c], ordered=True) for c in cut],
            [_packed(2 * arcs[c].astype(np.int64) + asked[c]) for c in cut],
            [_packed(lower[c]) for c in cut],
        ]
        state = [row["held"], many.tobytes(), np.stack([base, score]).tobytes(), *map(_packed, steps)]
        return pa.table(
            [
                pa.array([row["lot"]] * (k + 1), pa.int64()),
                pa.array([b for b, _, _ in runs] + [-1], pa.int32()),
                *[_binary(b + [None]) for b in blobs],
                pa.array([None] * k + [row["ids"]], pa.list_(pa.int64())),
                *[_binary([None] * k + [x]) for x in state],
            ],
            names,
        )

    # A part of the lots at a time, so that only that part is in a shuffle.
    done = []
    for part in range(PARTS):
        own, theirs = (x.where(F.pmod(F.xxhash64("lot"), F.lit(PARTS)) == part).groupBy("lot") for x in (lots, answers))
        done.append(settle(own.cogroup(theirs).applyInArrow(walk, first)))
    release(lots, shallow, deep)
    walked = reduce(DataFrame.unionAll, done)
    weights = (
        walked.where("bucket >= 0")
        .select("lot", "bucket", "keys", "arcs", "lower")
        .groupBy("bucket")
        .applyInArrow(_weighed, "lot long, bucket int, arcs binary, lower binary")
    )

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        right = right.sort_by("bucket")
        arcs, lower = (_joined(_unpacked(right.column(c), t), t) for c, t in (("arcs", np.int64), ("lower", float)))
        many = np.frombuffer(row["many"], np.int64).reshape(2, -1)
        base, score = np.frombuffer(row["score"]).reshape(2, -1)
        text, at, n = (_read(row[c], np.int64) for c in ("text", "place", "seen"))
        weight = np.maximum(DISCOUNT * arcs / n, 1e-9) / np.maximum(1 - lower, 1e-9)
        score = score + np.bincount(text, np.log10(weight)[at], len(score))
        return pa.table(
            [
                pa.array(row["ids"], pa.int64()),
                pa.array(np.frombuffer(row["held"], bool)),
                pa.array(many[0]),
                pa.array(many[1]),
                pa.array(np.full(len(base), total, np.int64)),
                pa.array(base),
                pa.array(score),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    state = walked.where("bucket < 0").select("lot", "ids", "held", "many", "score", "text", "place", "seen")
    return state.groupBy("lot").cogroup(weights.groupBy("lot")).applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
