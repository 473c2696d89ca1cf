"""Scoring of texts by a hierarchical Pitman-Yor model of words, three levels deep.

Every pair of training words that stand side by side is a context with a restaurant of the
words that follow it.  Its parent is the restaurant of the last word alone, whose parent is
one restaurant of all words, whose base is uniform over the vocabulary and one unknown word.
Customers are words; every table sends a customer to the parent.  Seats are sampled by Gibbs
(:mod:`.seating`), and predictive probabilities are averaged over samples.

Texts become blocks of word numbers.  A block sends the distinct triples (two words and the
next) that it holds, once, to the groups of their middle restaurants; a block fills at most
as many messages as it has such restaurants, so messages follow tokens.  A group holds whole
middle restaurants with all restaurants below, so nothing but the top restaurant is shared
between tasks.  A sweep seats each group anew under the top as the last sweep left it, and
reports the customers that it sends there; these are added up and seated by word.  In the
last sweep each group answers the blocks with averaged probabilities.

A word of more than ``part_tokens`` training tokens has several middle restaurants, one for
each part of the words before it, so no restaurant outgrows a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, textops
from .seating import Hierarchy, Seats, first_tables

#: The end of a text as a word; no word holds a space.
END = b" "
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Discounts and strengths of the levels, top first, that the first sweep starts from.
START = ((0.6, 0.75, 0.85), (1.0, 1.0, 1.0))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob: lengths and widths, then bytes of equal weight side by side, as many as there are any."""
    head, planes = [], []
    for x in arrays:
        x = x.view(f"<u{x.itemsize}")
        width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
        head += [len(x), width]
        planes += [(x >> x.dtype.type(8 * i)).astype(np.uint8).tobytes() for i in range(width)]
    raw = b"".join([np.array(head, "<i8").tobytes(), *planes])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd"), np.uint8)
    out, at = [], 16 * len(kinds)
    for kind, (n, width) in zip(kinds, raw[:at].view("<i8").reshape(-1, 2).tolist()):
        plain = np.dtype(f"<u{np.dtype(kind).itemsize}")
        x = raw[at : at + n].astype(plain)
        for i in range(1, width):
            x |= raw[at + i * n : at + (i + 1) * n].astype(plain) << plain.type(8 * i)
        out.append(x.view(kind))
        at += n * width
    return out


# ---- texts to blocks ---------------------------------------------------------------------

_BLOCKS = "block long, texts binary, spelled binary, entries long, n_train long"


def _blocks(block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        base, number = TaskContext.get().partitionId() << 32, 0
        names, held, counts, flat, sizes, size = [], [], [], [], [], 0

        def close() -> pa.RecordBatch:
            nonlocal number, names, held, counts, flat, sizes, size
            n, own = np.concatenate(counts), np.concatenate(held)
            coded = textops.binary_array(np.concatenate(flat), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))).dictionary_encode()
            words = [*coded.dictionary.to_pylist(), END]
            digest = xxhash.xxh3_64_intdigest
            hashes = np.fromiter((digest(w) for w in words), np.uint64, len(words))
            order = np.argsort(hashes)  # by hash, so that any number of groups cuts them in order
            turned = np.empty(len(words), np.uint32)
            turned[order] = np.arange(len(words))
            ids = np.full(len(coded) + len(n), turned[-1], np.uint32)
            last = np.cumsum(n + 1) - 1
            ids[textops.ragged(last - n, n)] = turned[coded.indices.to_numpy(zero_copy_only=False)]
            train = np.bincount(ids[np.repeat(~own, n + 1)], minlength=len(words)).astype(np.uint32)
            words = [words[i] for i in order.tolist()]
            spelled = _pack((hashes[order] >> np.uint64(32)).astype(np.uint32), np.fromiter(map(len, words), np.uint32, len(words)), np.frombuffer(b"".join(words), np.uint8), train)
            some = pa.concat_arrays(names)
            texts = _pack(pc.fill_null(some, 0).to_numpy(), some.is_valid().to_numpy(zero_copy_only=False), own, (n + 1).astype(np.int32), ids, turned[-1:])
            out = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((base + number, pa.int64()), (texts, pa.binary()), (spelled, pa.binary()), (len(words), pa.int64()), (int(train.sum()), pa.int64()))], [x.split()[0] for x in _BLOCKS.split(", ")])
            number += 1
            names, held, counts, flat, sizes, size = [], [], [], [], [], 0
            return out

        for batch in batches:
            for part in textops.pieces(batch, "text", 2 << 20):
                data, off = textops.utf8(part.column("text"))
                starts, ends, at = textops.words(data, off)
                flat.append(textops.LOWER[data[~textops.SPACE[data]]])  # words are all that is no white space
                sizes.append(ends - starts)
                counts.append(np.diff(at))
                names.append(part.column("doc_id"))
                held.append(part.column("held_out").to_numpy(zero_copy_only=False).astype(bool))
                size += len(starts) + len(off) - 1
                if size >= block_tokens:
                    yield close()
        if names:
            yield close()

    return run


def _spell(groups: int):
    """The words of each block and their training counts, one message for each group of words that it has some of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, spelled in zip(batch.column("block").to_pylist(), batch.column("spelled").to_pylist()):
                heads, lengths, letters, train = _unpack(spelled, "<u4", "<u4", "u1", "<u4")
                group = (heads.astype(np.uint64) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
                cut = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(group))
                at = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))[cut]
                blobs = [_pack(lengths[a:b], letters[c:d], train[a:b]) for a, b, c, d in zip(cut, cut[1:], at, at[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(blobs), pa.int64()), pa.array(group[cut[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["block", "g", "spelled"])

    return run


def _places(groups: int):
    """Numbers of the words of a group and their training counts, told to each block.

    The lowest two bits of a number tell whether the word occurs never, once or more often
    in training texts; ``known`` and ``once`` add up to the numbers of words seen there, and
    seen there once.
    """

    def close(g: int, blocks: list[int], blobs: list[bytes]) -> pa.RecordBatch:
        lengths, letters, train = zip(*(_unpack(x, "<u4", "u1", "<u4") for x in blobs))
        ends = np.cumsum([0, *map(len, lengths)])
        coded = textops.binary_array(np.concatenate(letters), np.concatenate(([0], np.cumsum(np.concatenate(lengths), dtype=np.int64)))).dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False)
        count = np.bincount(place, np.concatenate(train), minlength=len(coded.dictionary)).astype(np.int64)
        number = (np.arange(len(count)) * groups + g) << 2 | np.minimum(count, 2)
        told = [_pack(number[x], count[x]) for x in (place[a:b] for a, b in zip(ends, ends[1:]))]
        known, once = ([int(x.sum())] + [0] * (len(blocks) - 1) for x in (count > 0, count == 1))
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([g] * len(blocks), pa.int32()), pa.array(told, pa.binary()), pa.array(known, pa.int64()), pa.array(once, pa.int64())], ["block", "g", "told", "known", "once"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks, blobs = None, [], []
        for batch in batches:  # sorted by group
            for g, block, blob in zip(*(batch.column(x).to_pylist() for x in ("g", "block", "spelled"))):
                if g != now:
                    if blocks:
                        yield close(now, blocks, blobs)
                    now, blocks, blobs = g, [], []
                blocks.append(block)
                blobs.append(blob)
        if blocks:
            yield close(now, blocks, blobs)

    return run


_NAMED = "block long, texts binary, words binary, known long, once long"


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with numbers and training counts of their words (rows by block, the block itself first, then by group)."""

    def close() -> pa.RecordBatch:
        numbers, counts = (np.concatenate(x) for x in zip(*(_unpack(x, "<i8", "<i8") for x in told)))
        values = (own["block"], pa.int64()), (own["texts"], pa.binary()), (_pack(numbers, counts), pa.binary()), (known, pa.int64()), (once, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in values], [x.split()[0] for x in _NAMED.split(", ")])

    own, told, known, once = None, [], 0, 0
    for batch in batches:
        for row in batch.to_pylist():
            if row["g"] < 0:
                if own is not None:
                    yield close()
                own, told, known, once = row, [], 0, 0
            else:
                told.append(row["told"])
                known, once = known + row["known"], once + row["once"]
    if own is not None:
        yield close()


# ---- messages ----------------------------------------------------------------------------


def _sorted_unique(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows in order, by column, and the row of each entry."""
    key = columns[0].astype(np.int64)
    for column in columns[1:]:
        width = int(column.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 62) // width:  # number what there is, to make room
            own, key = np.unique(key, return_inverse=True)
        key = key * width + column
    order = np.argsort(key)
    key = key[order]
    new = np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))
    turned = np.empty(len(key), np.int64)
    turned[order] = np.cumsum(new) - 1
    at = order[new]
    return *(c[at] for c in columns), turned


class Block:
    """The distinct triples of a block in the order of its messages, and where each token's is."""

    def __init__(self, row: dict, groups: int, part_tokens: int):
        ids, valid, self.held, self.lengths, tokens, end = _unpack(row["texts"], "<i8", "?", "?", "<i4", "<u4", "<u4")
        self.doc_ids = pa.array(ids, mask=~valid)
        self.numbers, self.counts = _unpack(row["words"], "<i8", "<i8")
        self.ids = tokens.astype(np.int64)
        lengths = self.lengths.astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        one, two = np.empty(len(tokens), np.int64), np.empty(len(tokens), np.int64)
        one[1:], two[2:] = self.ids[:-1], self.ids[:-2]
        one[starts], two[starts], two[starts[lengths > 1] + 1] = end[0], end[0], end[0]
        v, u, w, turned = _sorted_unique(one, two, self.ids)
        parts = 1 + self.counts // part_tokens
        mixed = ((self.numbers.astype(np.uint64) * _MIX) >> np.uint64(33)).astype(np.int64)
        room = (self.numbers[v] << 20) | np.minimum(mixed[u] % parts[v], (1 << 20) - 1)
        group = ((((room.astype(np.uint64) * _MIX) >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(group.astype(np.min_scalar_type(groups)), kind="stable")  # few groups sort by radix
        self.group, self.room, self.u, self.w = group[order], room[order], self.numbers[u[order]], self.numbers[w[order]]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        self.turned = back[turned]

    def messages(self) -> Iterator[tuple[int, bytes]]:
        """For each group its triples as runs: rooms, words before, words, and training counts."""
        known = np.repeat(~self.held, self.lengths)
        train = np.bincount(self.turned[known], minlength=len(self.room)).astype(np.uint32)
        new_room = np.ones(len(self.room), bool)
        new_room[1:] = (self.room[1:] != self.room[:-1]) | (self.group[1:] != self.group[:-1])
        new_u = new_room.copy()
        new_u[1:] |= self.u[1:] != self.u[:-1]
        at_u, at_room = np.flatnonzero(new_u), np.flatnonzero(new_room)
        n_u = np.diff(np.append(at_u, len(self.u))).astype(np.uint32)
        n_room = np.diff(np.append(np.searchsorted(at_u, at_room), len(at_u))).astype(np.uint32)
        cut = np.flatnonzero(np.diff(self.group, prepend=-1))
        ends = np.append(cut[1:], len(self.group))
        for a, b, c, d, e, f in zip(cut, ends, np.searchsorted(at_u, cut), np.searchsorted(at_u, ends), np.searchsorted(at_room, cut), np.searchsorted(at_room, ends)):
            yield int(self.group[a]), _pack(self.room[at_room[e:f]], n_room[e:f], self.u[at_u[c:d]], n_u[c:d], self.w[a:b], train[a:b])


def _ask(groups: int, part_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sent = list(Block(row, groups, part_tokens).messages())
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(sent), pa.int64()), pa.array([x[0] for x in sent], pa.int32()), pa.array([x[1] for x in sent], pa.binary())], ["block", "g", "message"])

    return run


# ---- sweeps ------------------------------------------------------------------------------


class Top:
    """The top restaurant: its sizes, and what all levels are set to."""

    def __init__(self, customers: float, tables: float, words: int, discounts: tuple[float, ...], strengths: tuple[float, ...]):
        self.customers, self.tables, self.base = float(customers), float(tables), 1.0 / (words + 1)
        self.discounts, self.strengths = discounts, strengths

    def probability(self, customers, tables):
        """Predictive probabilities of words; for numbers, arrays and columns alike."""
        d, s = self.discounts[0], self.strengths[0]
        return (customers - tables * d + (s + d * self.tables) * self.base) / (s + self.customers)


def _groups_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[int, list[dict]]]:
    """The rows of one group at a time (rows are sorted by it)."""
    now, held = None, []
    for batch in batches:
        for row in batch.select(["g", *columns]).to_pylist():
            if row["g"] != now:
                if held:
                    yield now, held
                now, held = row["g"], []
            held.append(row)
    if held:
        yield now, held


def _with_top(batches: Iterator[pa.RecordBatch], top: Top | None) -> Iterator[tuple]:
    """``(shard, group, rows, words, probabilities)`` of one group at a time; a shard's words come first, as group -1."""
    words, chances, last = np.zeros(0, np.int64), np.zeros(0), None
    for turn, rows in _groups_of((b.rename_columns(["g", *b.schema.names[1:]]) for b in batches), "s", "block", "message"):
        s, g = rows[0]["s"], (turn & 0xFFFFFFFF) - 1
        if s != last:
            words, chances, last = np.zeros(0, np.int64), np.zeros(0), s
        if g < 0:
            words, customers, tables = (np.concatenate(x) for x in zip(*(_unpack(r["message"], "<i8", "<i8", "<i8") for r in rows)))
            order = np.argsort(words)
            words, chances = words[order], top.probability(customers[order], tables[order])
        else:
            yield s, g, rows, words, chances


def _opened(blobs: list[bytes]) -> tuple[np.ndarray, ...]:
    """Room, word before, word and training count of all triples of some messages, and their ends."""
    out, ends = [[], [], [], []], [0]
    for blob in blobs:
        room, n_room, u, n_u, w, train = _unpack(blob, "<i8", "<u4", "<i8", "<u4", "<i8", "<u4")
        for store, x in zip(out, (np.repeat(np.repeat(room, n_room), n_u), np.repeat(u, n_u), w, train)):
            store.append(x)
        ends.append(ends[-1] + len(w))
    return *(np.concatenate(x) for x in out), np.array(ends)


def _seat(blobs: list[bytes], words: np.ndarray, chances: np.ndarray, top: Top | None, seed: list[int]) -> tuple:
    """A group's hierarchy, the lowest dish of each triple, ends of messages, and the words of middle dishes."""
    room, u, w, train, ends = _opened(blobs)
    (rooms, room), (before, u), (names, w) = (np.unique(x, return_inverse=True) for x in (room, u, w))
    room, u, w, turned = _sorted_unique(room, u, w)
    count = np.bincount(turned, train, minlength=len(room)).astype(np.int64)
    low = np.concatenate(([0], np.cumsum((room[1:] != room[:-1]) | (u[1:] != u[:-1]))))
    middle, word, upper = _sorted_unique(room, w)
    rng = np.random.default_rng(seed)
    if top is None:  # the first sweep knows the top from its own group alone
        c = np.bincount(word, np.bincount(upper, count, minlength=len(word)) > 0, minlength=len(names))
        top = Top(c.sum(), (c > 0).sum(), len(names), *START)
        parent = top.probability(c, np.minimum(c, 1))
    else:
        parent = top.probability((names & 3).astype(float), (names & 3).astype(float))  # right for words seen never or once
        many = np.flatnonzero((names & 3) == 2)
        parent[many] = chances[np.searchsorted(words, names[many])]
    own = Hierarchy(count, upper, low, middle, parent[word], top.discounts[1:], top.strengths[1:], rng)
    return own, turned, ends, names[word]


_REPORTS = "s int, g int, message binary, hints array<double>"


def _report(top: Top | None, rounds: int, number: int, seed: int, of_words: int):
    """Customers that a shard sends to the top, for words seen more than once, by group of words; and hints of the levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, sent, hints = None, [], [], 0.0

        def close() -> pa.RecordBatch:
            names, turned = np.unique(np.concatenate(words), return_inverse=True)
            n = np.bincount(turned, np.concatenate(sent), minlength=len(names)).astype(np.int64)
            group = (names >> 2) % of_words
            order = np.argsort(group, kind="stable")
            cut = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
            blobs = [_pack(names[x], n[x]) for x in (order[a:b] for a, b in zip(cut, cut[1:]))]
            own = [*group[order][cut[:-1]].tolist(), -1]
            return pa.RecordBatch.from_arrays([pa.array([now] * len(own), pa.int32()), pa.array(own, pa.int32()), pa.array([*blobs, None], pa.binary()), pa.array([None] * len(blobs) + [list(hints)], pa.list_(pa.float64()))], ["s", "g", "message", "hints"])

        for s, g, rows, own_words, chances in _with_top(batches, top):
            if now is not None and s != now:
                yield close()
                words, sent, hints = [], [], 0.0
            now = s
            own, _, _, names = _seat([r["message"] for r in rows], own_words, chances, top, [seed, number, g])
            for _ in range(rounds):
                own.round()
            many = (names & 3) == 2
            words.append(names[many])
            sent.append(own.mid.t[many])
            hints = hints + np.array(own.hints())
        if now is not None:
            yield close()

    return run


_ROOMS = "s int, message binary, customers long, tables long"


def _seat_top(discount: float, strength: float, tables: float, base: float, rounds: int, number: int, seed: int):
    """Tables of words in the top restaurant, sampled a group of words at a time and told to each shard.

    ``customers`` and ``tables`` add up to those of all words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, rows in _groups_of(batches, "s", "message"):
            rng = np.random.default_rng([seed, number, 1, g])
            words, sent = zip(*(_unpack(r["message"], "<i8", "<i8") for r in rows))
            names, turned = np.unique(np.concatenate(words), return_inverse=True)
            n = np.bincount(turned, np.concatenate(sent), minlength=len(names)).astype(np.int64)
            weight = np.full(len(n), (strength + discount * tables) * base)
            own = Seats(n, first_tables(n, weight, discount, rng), discount, rng)
            for _ in range(rounds):
                if len(who := np.flatnonzero(own.c > 1)):
                    own.leave(who)
                    own.sit(who, weight[who])
            ends = np.cumsum([0, *map(len, words)])
            told = [_pack(names[x], n[x], own.t[x]) for x in (turned[a:b] for a, b in zip(ends, ends[1:]))]
            sums = ([int(x.sum())] + [0] * (len(rows) - 1) for x in (n, own.t))
            yield pa.RecordBatch.from_arrays([pa.array([r["s"] for r in rows], pa.int32()), pa.array(told, pa.binary()), *(pa.array(x, pa.int64()) for x in sums)], ["s", "message", "customers", "tables"])

    return run


_ANSWERS = "block long, g int, logs binary"


def _answer(top: Top, rounds: int, samples: int, apart: int, number: int, seed: int):
    """Logarithms of the averaged probabilities of each message's triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, g, rows, words, chances in _with_top(batches, top):
            own, turned, ends, _ = _seat([r["message"] for r in rows], words, chances, top, [seed, number, g])
            blocks = [r["block"] for r in rows]
            for _ in range(rounds):
                own.round()
            total = np.zeros(len(own.count))
            for _ in range(samples):
                for _ in range(apart):
                    own.round()
                total += own.probabilities()
            logs = np.log10(total / samples).astype(np.float32)[turned]
            packed = [_pack(logs[a:b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array([g] * len(blocks), pa.int32()), pa.array(packed, pa.binary())], ["block", "g", "logs"])

    return run


# ---- scores ------------------------------------------------------------------------------

_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(n_train: int, distinct: int, groups: int, part_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            block = Block(own, groups, part_tokens)
            logs = np.concatenate(parts).astype(float)
            base = np.log10((block.counts + 0.1) / (n_train + 0.1 * (distinct + 1)))
            lengths = block.lengths.astype(np.int64)
            total = lambda x: np.add.reduceat(x, np.cumsum(lengths) - lengths)
            return pa.RecordBatch.from_arrays(
                [block.doc_ids, pa.array(block.held), pa.array(lengths), pa.array(total((block.counts > 0)[block.ids].astype(np.int64))), pa.array(np.full(len(lengths), n_train)), pa.array(total(base[block.ids])), pa.array(total(logs[block.turned]))],
                [x.split()[0] for x in _SCORES.split(", ")],
            )

        own, parts = None, []
        for batch in batches:  # by block: the block itself, then its answers by group
            for row in batch.to_pylist():
                if row["g"] < 0:
                    if own is not None:
                        yield close()
                    own, parts = row, []
                else:
                    parts.append(_unpack(row["logs"], "<f4")[0])
        if own is not None:
            yield close()

    return run


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, sweeps: int = 2, rounds: int = 4, samples: int = 3, apart: int = 1,
    block_tokens: int = 1 << 20, shard_tokens: int = 1 << 22, part_tokens: int = 1 << 20, discounts: tuple[float, ...] | None = None, strengths: tuple[float, ...] | None = None, seed: int = 11,
) -> DataFrame:
    """Log probabilities of every row's whole text, and those of an add-0.1 unigram model.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.  The
    model learns from the rows whose crc32 of the id as text (null: '') leaves a remainder
    by ``folds``.  A-Z count as a-z, each text ends in one end token, and a null or empty
    text is that token alone; texts of any length are scored whole.  Repeated rows count and
    are scored each; an empty table gives an empty table; further columns are ignored,
    whatever their names.  ``sweeps`` of ``rounds`` Gibbs rounds update the top restaurant;
    the last one averages ``samples`` states ``apart`` rounds apart.  Discounts and strengths
    (top first) are estimated from the seats of the first sweep where they are not given.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        ((F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % folds) == 0).alias("held_out"),
        F.col(text_col).cast("string").alias("text"),
    )
    begun = scratch.mark()
    blocks = scratch.table(rows.mapInArrow(_blocks(block_tokens), _BLOCKS), "blocks")
    size = blocks.agg(F.sum("entries").alias("entries"), F.sum("n_train").alias("tokens")).first()
    entries, n_train = size["entries"] or 0, size["tokens"] or 0
    # Tasks and groups follow what they hold; a block fills no more messages than it has words.
    parts, shards = max(16, entries >> 20), max(16, -(-n_train // shard_tokens))
    of_words, groups = max(256, entries >> 18), max(256, n_train >> 18)
    spelled = blocks.select("block", "spelled").mapInArrow(_spell(of_words), "block long, g int, spelled binary").repartitionById(parts, "g").sortWithinPartitions("g")
    told = spelled.mapInArrow(_places(of_words), "block long, g int, told binary, known long, once long")
    both = blocks.select("block", F.lit(-1).alias("g"), "texts").unionByName(told, allowMissingColumns=True)
    blocks = scratch.table(both.repartition(shards, "block").sortWithinPartitions("block", "g").mapInArrow(_named, _NAMED), "blocks")
    size = blocks.agg(F.sum("known").alias("known"), F.sum("once").alias("once")).first()
    distinct, once = size["known"] or 0, size["once"] or 0
    blocks = blocks.select("block", "texts", "words")
    _forget(spark, begun)

    asked = blocks.mapInArrow(_ask(groups, part_tokens), "block long, g int, message binary").select((F.col("g") % shards).alias("s"), "g", "block", "message")
    start = scratch.mark()
    top = rooms = None
    for number in range(sweeps):
        dealt = asked
        if rooms is not None:
            dealt = asked.unionByName(rooms.select("s", F.lit(-1).alias("g"), "message"), allowMissingColumns=True)
        # One column to sort by, so that Spark sorts by radix.
        dealt = dealt.select((F.shiftleft(F.col("s").cast("long"), 32) + F.col("g") + 1).alias("turn"), "s", "block", "message").repartitionById(shards, "s").sortWithinPartitions("turn")
        if number == sweeps - 1:
            break
        reports = scratch.table(dealt.mapInArrow(_report(top, rounds, number, seed, of_words), _REPORTS), "reports")
        hints = reports.where("hints is not null").agg(*(F.sum(F.col("hints")[i]) for i in range(8))).first()
        d, s = _levels([x or 0.0 for x in hints], top, discounts, strengths, np.random.default_rng([seed, number]))
        words = reports.where("message is not null").select("s", "g", "message").repartitionById(parts, "g").sortWithinPartitions("g")
        rooms = scratch.table(words.mapInArrow(_seat_top(d[0], s[0], distinct if top is None else top.tables, 1.0 / (distinct + 1), rounds, number, seed), _ROOMS), "rooms")
        size = rooms.agg(F.sum("customers").alias("n"), F.sum("tables").alias("t")).first()
        top = Top((size["n"] or 0) + once, (size["t"] or 0) + once, distinct, d, s)
        del dealt, reports, words
        _forget(spark, start)

    if top is None:
        raise ValueError("sweeps must be 2 at least: the first one only starts the top")
    answers = dealt.mapInArrow(_answer(top, rounds, samples, apart, sweeps - 1, seed), _ANSWERS)
    whole = blocks.withColumn("g", F.lit(-1)).unionByName(answers, allowMissingColumns=True)
    return whole.repartition(shards, "block").sortWithinPartitions("block", "g").mapInArrow(_scores(n_train, distinct, groups, part_tokens), _SCORES)


def _forget(spark, start: int) -> None:
    """Delete all tables written since ``start`` but the last one, and let Spark drop shuffle files of steps that are over."""
    import gc

    scratch.release(spark, start, scratch.mark() - 1)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _levels(hints: list[float], top: Top | None, discounts, strengths, rng: np.random.Generator) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Discounts from dishes of one and two customers; strengths drawn given the seats (gamma prior of 1, 1)."""
    before = (top.discounts, top.strengths) if top is not None else START
    d, s = list(before[0]), list(before[1])
    for level, (one, two, y, log_x) in ((3, hints[:4]), (2, hints[4:])):
        d[level - 1] = float(np.clip(one / max(1.0, one + 2 * two), 0.1, 0.95))
        s[level - 1] = float(rng.gamma(1 + y, 1 / (1 - log_x)))
    return tuple(discounts or d), tuple(strengths or s)
