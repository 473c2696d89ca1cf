"""The language model against counting, plain sequential Gibbs sampling and the laws of probability."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from diskloom.llm import language_model, seating
from tests.llm import corpus


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 10 == 0


def test_scores_count_exactly(spark):
    docs = spark.createDataFrame(corpus.rows(), corpus.SCHEMA).repartition(5)
    rows = language_model.score(docs, block_tokens=2000, shard_tokens=1000, part_tokens=500).collect()
    said = {}
    for i, t, *_ in corpus.rows():
        words = [*corpus.WORD.findall((t or "").translate(corpus.LOW)), None]
        said.setdefault((i, len(words)), []).append((words, held(i)))
    train = Counter(w for many in said.values() for words, out in many if not out for w in words)
    n, v = sum(train.values()), len(train)
    assert len(rows) == len(corpus.rows())
    for r in rows:
        words, out = said[r["doc_id"], r["n_tokens"]][0]
        assert (r["held_out"], r["n_known"], r["train_tokens"]) == (out, sum(train[w] > 0 for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel=1e-9)
        assert r["score"] < 0
    assert language_model.score(spark.createDataFrame([], corpus.SCHEMA)).count() == 0


def ids(kind, many):
    return [i for i in range(40 * many + 400) if held(i) == kind][:many]


def brute(texts, asked, discounts, strengths, sweeps, burn, seed=0):
    """Mean predictive probability of each token of ``asked`` by sequential Gibbs sampling, one customer at a time."""
    rng = random.Random(seed)
    rooms = defaultdict(lambda: defaultdict(list))  # context -> word -> table sizes
    words = {w for t in texts for w in t}
    base = 1 / (len(words) + 1)

    def probability(context, w):
        if context is None:
            return base
        room, level = rooms[context], len(context)
        c, t = sum(sum(x) for x in room.values()), sum(len(x) for x in room.values())
        d, s = discounts[level], strengths[level]
        own = room.get(w, [])
        return (sum(own) - d * len(own) + (s + d * t) * probability(up(context), w)) / (s + c)

    def up(context):
        return context[1:] if context else None

    def sit(context, w):
        if context is None:
            return
        room, level = rooms[context], len(context)
        d, s = discounts[level], strengths[level]
        t = sum(len(x) for x in room.values())
        weights = [x - d for x in room[w]] + [(s + d * t) * probability(up(context), w)]
        k = rng.choices(range(len(weights)), weights)[0]
        if k == len(room[w]):
            room[w].append(1)
            sit(up(context), w)
        else:
            room[w][k] += 1

    def leave(context, w):
        if context is None:
            return
        tables = rooms[context][w]
        k = rng.choices(range(len(tables)), tables)[0]
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            leave(up(context), w)

    def tokens(t):
        padded = [None, None, *t]
        return [((padded[i], padded[i + 1]), padded[i + 2]) for i in range(len(t))]

    every = [x for t in texts for x in tokens(t)]
    for x in every:
        sit(*x)
    out = [np.zeros(len(t)) for t in asked]
    for sweep in range(burn + sweeps):
        for x in every:
            leave(*x)
            sit(*x)
        if sweep >= burn:
            for total, t in zip(out, asked):
                total += [probability(*x) for x in tokens(t)]
    return [np.log10(x / sweeps).sum() for x in out]


def small_corpus():
    rng = random.Random(8)
    follow = {w: rng.choices([f"w{i}" for i in range(9)], k=3) for w in [f"w{i}" for i in range(9)]}

    def text():
        out = [f"w{rng.randrange(9)}"]
        while len(out) < 12:
            out.append(rng.choice(follow[out[-1]]) if rng.random() < 0.7 else f"w{rng.randrange(9)}")
        return out

    return [text() for _ in range(60)], [text() for _ in range(12)]


LEVELS = (0.4, 0.5, 0.6), (1.0, 1.5, 0.7)


def test_hierarchy_agrees_with_sequential_gibbs():
    """The array sampler, with the top re-seated between its rounds, against one customer after another."""
    train, asked = ([[*t, None] for t in x] for x in small_corpus())
    d, s = LEVELS
    wanted = brute(train, asked, d, s, 60, 30)
    number = {w: i for i, w in enumerate([None, *sorted({w for t in train for w in t if w})])}
    triples = lambda t: [(number[b], number[a], number[w]) for a, b, w in zip([None, None, *t], [None, *t], t)]
    keys = sorted({x for t in train + asked for x in triples(t)})
    at, n = {k: i for i, k in enumerate(keys)}, len(number)
    count = np.bincount([at[x] for t in train for x in triples(t)], minlength=len(keys)).astype(np.int64)
    v, u, w = np.array(keys).T
    _, room = np.unique(v * 100 + u, return_inverse=True)
    pairs, upper = np.unique(v * 100 + w, return_inverse=True)
    middle, word = np.divmod(pairs, 100)
    rng = np.random.default_rng(3)
    c = np.bincount(word, np.bincount(upper, count) > 0, minlength=n).astype(np.int64)
    t = np.minimum(c, 1)
    chance = lambda: (c - d[0] * t + (s[0] + d[0] * t.sum()) / (n + 1)) / (s[0] + c.sum())
    own = seating.Hierarchy(count, upper, room, middle, chance()[word], d[1:], s[1:], rng)
    total = np.zeros(len(keys))
    for step in range(100):
        own.parent = chance()[word]
        for _ in range(5):
            own.round()
        c = np.bincount(word, own.mid.t, minlength=n).astype(np.int64)
        top = seating.Seats(c, np.minimum(c, np.maximum(1, t)), d[0], rng)
        weight = np.full(n, (s[0] + d[0] * t.sum()) / (n + 1))
        for _ in range(10):
            top.leave(who := np.flatnonzero(top.c > 1))
            top.sit(who, weight[who])
        t = top.t.copy()
        total += own.probabilities() if step >= 30 else 0
    found = [np.log10(total[[at[x] for x in triples(text)]] / 70).sum() for text in asked]
    assert found == pytest.approx(wanted, abs=0.25)
    assert sum(found) == pytest.approx(sum(wanted), rel=0.01)


def test_scores_agree_with_sequential_gibbs(spark):
    """The same through the tables; the last sweep's top is one sample, so single texts differ a little more."""
    train, asked = small_corpus()
    asked += [["w1", "new", "w2"], []]
    d, s = LEVELS
    wanted = brute([[*t, None] for t in train], [[*t, None] for t in asked], d, s, 60, 30)
    data = [*zip(ids(False, 60), map(" ".join, train)), *zip(ids(True, 14), map(" ".join, asked))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    scored = {r["doc_id"]: r["score"] for r in language_model.score(docs, sweeps=4, rounds=12, samples=30, apart=2, discounts=d, strengths=s).collect()}
    found = [scored[i] for i in ids(True, 14)]
    assert found == pytest.approx(wanted, abs=0.5)
    assert sum(found) == pytest.approx(sum(wanted), rel=0.02)


def test_a_dish_follows_the_restaurant_s_law():
    """Tables of one dish under Gibbs steps have the law that exact enumeration gives."""
    d, weight, c, rng = 0.5, 0.7, 6, np.random.default_rng(0)
    stirling = {(1, 1): 1.0}
    for k in range(2, c + 1):
        for t in range(1, k + 1):
            stirling[k, t] = stirling.get((k - 1, t - 1), 0) + (k - 1 - d * t) * stirling.get((k - 1, t), 0)
    law = np.array([stirling[c, t] * weight**t for t in range(1, c + 1)])
    law /= law.sum()
    seats = seating.Seats(np.full(20000, c), np.ones(20000, np.int64), d, rng)
    who = np.arange(20000)
    for _ in range(60):
        seats.leave(who)
        seats.sit(who, np.full(20000, weight))
        assert len(seats.size) == seats.t.sum() and (seats.c == c).all()
    assert np.bincount(seats.t, minlength=c + 1)[1:] / 20000 == pytest.approx(law, abs=0.02)
    assert np.bincount(np.repeat(who, seats.t), seats.size).tolist() == [c] * 20000


def test_seats_come_and_go():
    rng = np.random.default_rng(1)
    c = rng.integers(0, 9, 500)
    seats = seating.Seats(c, seating.first_tables(c, np.full(500, 0.5), 0.4, rng), 0.4, rng)
    who = np.flatnonzero(rng.random(500) < 0.5)
    by = rng.integers(-3, 4, len(who))
    by = np.maximum(by, -c[who])
    seats.change(who, by, np.full(len(who), 0.5))
    c[who] += by
    assert seats.c.tolist() == c.tolist() and ((seats.t > 0) == (c > 0)).all() and (seats.size > 0).all()
    assert np.bincount(np.repeat(np.arange(500), seats.t), seats.size, minlength=500).tolist() == c.tolist()


def test_predictive_probabilities_sum_to_one_in_every_restaurant():
    """All words after each context, seen there or not, with restaurants of all three levels occupied."""
    rng, v = np.random.default_rng(2), 7
    room = np.repeat(np.arange(15), v)  # contexts, of 5 last words
    word, middle = np.tile(np.arange(v), 15), np.repeat(np.arange(5), v)
    count = rng.integers(0, 6, len(room))
    parent = rng.dirichlet(np.ones(v))
    own = seating.Hierarchy(count, room % 5 * v + word, room, middle, np.tile(parent, 5), (0.5, 0.7), (1.0, 2.0), rng)
    for _ in range(5):
        own.round()
        assert np.bincount(room, own.probabilities()) == pytest.approx(np.ones(15))
        assert own.mid.c.sum() == own.tables3.sum() and own.mid.t.sum() == own.tables2.sum()
        assert np.bincount(middle, own.mid.c).tolist() == own.customers2.tolist() and np.bincount(middle, own.mid.t).tolist() == own.tables2.tolist()


def test_rare_words_are_contexts_too(spark):
    """In 10,000 tokens a word seen twice foretells the one that always follows it."""
    rng = random.Random(5)
    train, asked = ids(False, 500), ids(True, 4)
    texts = [" ".join(rng.choices([f"v{k}" for k in range(50)], k=20)) for _ in range(500)]
    texts[:2] = [t + " rare next" for t in texts[:2]]
    data = [*zip(train, texts), (asked[0], "rare next"), (asked[1], "rare"), (asked[2], "v1 next"), (asked[3], "v1")]
    rows = {r["doc_id"]: r["score"] for r in language_model.score(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    # Both pairs of texts differ by p(next | context) p(end | next) / p(end | context).
    assert rows[asked[0]] - rows[asked[1]] > rows[asked[2]] - rows[asked[3]] + 1


@pytest.mark.parametrize("share", [1 << 30, 3])
def test_messages_hold_a_block_s_triples(share):
    """Triples and counts come back whole from the messages, however a word's restaurants are split."""
    rng = np.random.default_rng(4)
    lengths = np.array([1, 2, 5, 40, 3], np.int32)
    tokens = rng.integers(0, 6, int(lengths.sum())).astype(np.uint32)
    tokens[np.cumsum(lengths) - 1] = 6
    held_out = np.array([False, True, False, False, True])
    counts = np.arange(1, 8)
    row = {"texts": language_model._pack(np.arange(5), np.ones(5, bool), held_out, lengths, tokens, np.array([6], np.uint32)), "words": language_model._pack(np.arange(7) * 4 + 2, counts)}
    block = language_model.Block(row, 4, share)
    sent = list(block.messages())
    room, u, w, train, ends = language_model._opened([x for _, x in sent])
    wanted, at = Counter(), 0
    for n, out in zip(lengths, held_out):
        words = [6, 6, *tokens[at : at + n].tolist()]
        for i in range(n):
            wanted[words[i + 1], words[i], words[i + 2]] += not out
        at += n
    got = Counter()
    for r, a, b, c in zip(room.tolist(), u.tolist(), w.tolist(), train.tolist()):
        got[(r >> 20) // 4, a // 4, b // 4] += c
    assert got == wanted and len(room) == len(wanted) == len(block.u) == ends[-1]
    assert [g for g, _ in sent] == sorted({g for g, _ in sent})
    assert pa.array(block.doc_ids).to_pylist() == list(range(5))
