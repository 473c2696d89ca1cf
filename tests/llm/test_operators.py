"""The ten operators against brute force, exact round trips or held-out accuracy."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from diskloom.llm import entries, exact_dedup, html_text, media, mixing, packing, quality, repeats, simhash, textops, token_counts, tokens
from tests.llm import corpus

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus.rows(), corpus.SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], corpus.SCHEMA)


def by_row(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def library_ids(texts, special=True):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(VOCABULARY)
    if not special:
        own.encode_special_tokens = True
    return [x.ids for x in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


# ---- tokens and packing ------------------------------------------------------------------


def test_segments_give_the_library_s_ids():
    import pyarrow as pa

    rng = random.Random(5)
    alphabet = [" ", "\n", "\t", "a", "B", "é", "'s", "’", " ", "　", " ", "\x1c", "9", "-", "ß", "中", "\U0001f600", "  ", " the"]
    texts = [t or "" for t in corpus.texts()] + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(3000)]
    texts += ["<|endoftext|>", "x<|endoftext|>y", " <|endoftext|> <|endoftext|>", "", "<|endoftext", "|><|endoftext|>\n"]
    for special in (False, True):
        ids, at = tokens.SegmentEncoder(VOCABULARY, special)(*textops.utf8(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library_ids(texts, special)
    assert library_ids(["x<|endoftext|>y"])[0][1] == 50256


@pytest.mark.parametrize("special", [False, True])
def test_very_long_texts_are_encoded_in_parts(monkeypatch, special):
    import pyarrow as pa

    monkeypatch.setattr(tokens, "_MOST", 64)
    texts = [" ".join(t or "" for t in corpus.texts()[:60]), "", "x" * 500, "<|endoftext|>".join(["a b  c\n\n d"] * 40), " " * 300 + "é" * 200 + "\n" * 90]
    ids, at = tokens.SegmentEncoder(VOCABULARY, special)(*textops.utf8(pa.array(texts)))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == library_ids(texts, special)


def test_pieces_and_packing(docs, none):
    found = packing.pack(packing.token_pieces(docs, VOCABULARY, 256), 256).collect()
    wanted = []
    for row, ids in zip(corpus.rows(), library_ids([r[1] for r in corpus.rows()])):
        ids = [*ids, 0]
        first = len(ids) % 256 or 256
        cuts = [0, *range(first, len(ids) + 1, 256)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            wanted.append((row[0], k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))))
    assert sorted(wanted, key=repr) == sorted((tuple(r)[:5] for r in found), key=repr)
    bins = defaultdict(list)
    for r in found:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert len(bins) <= math.ceil(sum(r["length"] for r in found) / 256) + 2
    assert packing.pack(packing.token_pieces(none, VOCABULARY)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_packing_of_any_histogram(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 300, 2048])
    counts = Counter(min(capacity, max(1, int(rng.expovariate(1 / (capacity * rng.choice([0.05, 0.3, 0.6])))))) for _ in range(rng.randrange(1, 3000)))
    slots = sorted(packing.solve(counts, capacity))
    fill = defaultdict(list)
    for length, count in counts.items():
        own = [s for s in slots if s[0] == length]
        for s, following in zip(own, [*(x[1] for x in own[1:]), count]):
            for i in range(following - s[1]):
                fill[s[2] + i // s[3]].append((s[4] + i % s[3] * length, length))
    assert sum(len(x) for x in fill.values()) == sum(counts.values())
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity and sum(3 * n > capacity for _, n in spans) <= 2
    # No worse than best fit decreasing, one piece at a time.
    free = []
    for n in sorted(counts.elements(), reverse=True):
        fits = [g for g in free if g >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(capacity - n)
    assert len(fill) <= math.ceil(len(free) * 1.02) + 1


# ---- repeats -----------------------------------------------------------------------------


def test_repeats_are_removed_exactly(docs, none):
    raw = [(r[1] or "").encode() for r in corpus.rows()]
    wanted = []
    for row, b, mark in zip(corpus.rows(), raw, corpus.repeats(raw)):
        kept = bytes(x for x, m in zip(b, mark) if not m)
        wanted.append((row[0], len(b), sum(mark), len(re.findall(rb"\x01+", bytes(mark))), hashlib.sha256(kept).hexdigest()))
    found = [(r["doc_id"], r["n_bytes"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in repeats.remove_repeats(docs).collect()]
    assert sorted(wanted, key=repr) == sorted(found, key=repr)
    assert repeats.remove_repeats(none).count() == 0


def test_repeats_across_many_buckets(spark):
    """Passages with all kinds of left and right neighbours, over more buckets than runs."""
    rng = random.Random(1)
    letters = lambda n: "".join(rng.choices("abcd", k=n))
    cores = [letters(rng.randrange(150, 420)) for _ in range(6)]
    data = []
    for i in range(150):
        core = rng.choice(cores)
        cut = rng.randrange(0, 60)
        data.append((i, letters(rng.choice([0, 1, 40, 160])) + core[cut : len(core) - rng.randrange(0, 60)] + letters(rng.choice([0, 3, 120]))))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame(data, "doc_id long, text string"), range_rows=16).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for (i, text), mark in zip(data, corpus.repeats([t.encode() for _, t in data])):
        assert rows[i]["kept"] == bytes(x for x, m in zip(text.encode(), mark) if not m), i


@pytest.mark.parametrize("few", [1, 48])
def test_multikey_order(few):
    rng = np.random.default_rng(2)
    tokens_ = rng.integers(0, 3, (500, 8)).astype(np.uint64)
    order = repeats.multikey_order(tokens_, few)
    assert [tuple(x) for x in tokens_[order]] == sorted(map(tuple, tokens_))


def test_equal_hashes_are_not_taken_for_equal_strings(spark, monkeypatch):
    """All grams hash alike, so every anchor is followed up; only equal bytes go."""
    monkeypatch.setattr(repeats, "gram_hashes", lambda data: np.zeros(max(0, len(data) - repeats.GRAM + 1), np.uint64))
    rng = random.Random(6)
    letters = lambda n: "".join(rng.choices("ab", k=n))
    core = letters(260)
    texts = [letters(rng.randrange(150, 600)) + (core if i % 3 else core[:199]) + letters(rng.randrange(90)) for i in range(20)]
    found = [b for b in _anchored(texts)]
    assert found == [bytes(x) for x in corpus.repeats([t.encode() for t in texts])]


def _anchored(texts):
    """The covered bytes of some texts by anchors and compare(), without Spark."""
    import pyarrow as pa

    data, off = textops.utf8(pa.array(texts))
    row, at, _, near, far = repeats.anchors(data, off)
    begin = at - far
    lefts = [data[off[r] + a : off[r] + a + f].tobytes() for r, a, f in zip(row, begin, far)]
    rights = [data[off[r] + p : off[r] + p + repeats.LENGTH - n].tobytes() for r, p, n in zip(row, at, near)]
    covered, _ = repeats.compare(lefts, rights, near, far, np.ones(len(row), np.int64))
    marks = [bytearray(len(t.encode())) for t in texts]
    for i, d in zip(*np.nonzero(covered)):
        a = at[i] - d
        marks[row[i]][a : a + repeats.LENGTH] = b"\1" * repeats.LENGTH
    return [bytes(x) for x in marks]


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    import pyarrow as pa

    rng = random.Random(9)
    core = "".join(rng.choices("abcdefgh", k=300))
    text = "".join(rng.choices("abcdefgh", k=5000)) + core + "".join(rng.choices("abcdefgh", k=777)) + core
    data, off = textops.utf8(pa.array([text, "", "short", text[:450]]))
    whole = {(int(r), int(p) - int(d)) for r, p, _, n, f in zip(*repeats.anchors(data, off)) for d in range(n, f + 1)}
    parts = set()
    for own, ends, rows, places in repeats._slices(data, off, 512):
        assert len(own) <= 2 * 512 + repeats.LENGTH
        for r, p, _, n, f in zip(*repeats.anchors(own, ends)):
            parts |= {(int(rows[r]), int(places[r] + p) - d) for d in range(n, f + 1)}
    assert parts == whole


# ---- pages -------------------------------------------------------------------------------


@pytest.mark.parametrize("html,text", [
    (None, ""), ("", ""), ("plain words", "plain words"), ("<p>a&amp;b&nbsp; c\n d</p>", "a&b c d"),
    ("<nav><ul><li><a href=x>Menu</a></ul></nav><article><h1>T</h1><p>One<br>two</p><aside>no</aside><p>three</p></article><footer>f</footer>", "T\nOne two\nthree"),
    ("<body><div class='sidebar'>side side side</div><div id=main><p>" + "word " * 40 + "</p><div class=\"ad banner\">buy</div><p>end.</p></div><section id='comments'><p>" + "nice " * 60 + "</p></section>", ("word " * 40).strip() + "\nend."),
    ("<script>var a='</p><article>x</article>';</script><style>p{}</style><!-- <p>no</p> --><article><p>yes &#233; &lt;b&gt;</article>", "yes é <b>"),
    ("<article><header><h1>Head</h1></header><p>x</p><form><input><p>sign up</p></form></article>", "Head\nx"),
    ("<article><p>cut off <b>here", "cut off here"), ("<article><p>a < b and c > d</p></article>", "a < b and c > d"), ("<article><div><div><p>deep</p></div></article><div class=cookie-notice>ok?</div>", "deep"),
    ('<article><div class="article-header"><h1>Head</h1></div><p class="ad">buy</p><p data-hidden=1>x</p><ol class="commentlist"><li>nice</li></ol></article>', "Head\nx"),
    ('<div class="page-header">Site</div><main><p>one</p><div class="notice">n</div><p>two</p><div role=alert>a</div></main>', "one\ntwo"),
    ('<p title="a > b">attr</p>', "attr"), ("<article></article><div><p>outside " + "x " * 50 + "</p></div>", "outside " + ("x " * 50).strip()),
])
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_text_beside_an_article():
    body = ("word " * 60).strip()
    assert html_text.main_text(f"<div><p>{body}</p></div><article class=comment><p>{'nice ' * 50}</p></article>") == body
    assert html_text.main_text(f"<div><p>{body}</p></div><article><p>Read more</p></article>") == body
    assert html_text.main_text(f"<article><p>{body}</p><nav>n</nav><p>end</p></article><div><p>(c)</p></div>") == f"{body}\nend"


def test_names_are_read_as_whole_words():
    assert html_text.main_text("<article><p class='notice-period'>Body one.</p><p>Two</p></article>") == "Body one.\nTwo"
    assert html_text.main_text("<article><h1>T</h1><section class='related-work'><p>Others.</p></section><section id='search-algorithms'><p>Search.</p></section></article>") == "T\nOthers.\nSearch."
    for name in ("cookie-notice", "ad", "ad-slot_2", "comment-list", "related-posts", "site-footer", "Sidebar", "nav-menu", "search-form", "x reader-comments", "ad2", "ad_300x250-slot", "disqus_thread"):
        assert html_text.main_text(f"<article><p>Body.</p><div class='{name}'><p>Not this.</p></div></article>") == "Body.", name
    body = "<p>" + "word " * 60 + "</p>"
    page = f"<body><p>Intro para one.</p><ul class=menu><li><a href=a>A</a></ul>{body}<ul><li><a href=b>Link</a><li><a href=c>Link</a></ul><p>Closing words.</p></body>"
    assert html_text.main_text(page) == "Intro para one.\n" + ("word " * 60).strip() + "\nClosing words."


def test_the_window_decides_on_pages_with_articles():
    page = f"<article><p>{'a' * 200}</p></article><div><p>{'b' * 30}</p><p>{'c' * 30}</p><p>{'d' * 30}</p></div>"
    assert [len(html_text.main_text(page, window=w).split("\n")) for w in (1, 2, 3)] == [1, 4, 4]
    assert html_text.main_text(page, part=0.9).count("b") == 30 and html_text.main_text(page, surge=300, part=0.9).count("b") == 0


def by_windows(page, window):
    """The method, written out: lines between surges and dives of window sums, and lines of their blocks."""
    every = html_text.lines(page, window)
    size = [len(t) if not furniture and (inside or 2 * linked <= len(t)) else 0 for t, linked, inside, furniture, _ in every]
    total = lambda i: sum(size[i : i + window])
    peak = max(map(total, range(len(size))), default=0)
    run, number = [], 0
    for i in range(len(size)):
        number += total(i) == 0
        run.append(number if total(i) else None)
    of = lambda n: [i for i in range(len(size)) if run[i] == n and size[i]]
    hinted = any(total(i) == peak and any(every[j][2] for j in of(run[i])) for i in range(len(size)) if run[i] is not None)
    surges = {n for n in set(run) - {None} if max(total(i) for i in range(len(size)) if run[i] == n) >= min(86, 0.2 * peak) or (hinted and any(every[j][2] for j in of(n)))}
    blocks = {every[i][4] for n in surges for i in of(n)}
    return "\n".join(every[i][0] for i in range(len(size)) if size[i] and (run[i] in surges or every[i][4] in blocks))


def test_pages_agree_with_windows_written_out(spark):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    cut = [p.replace("<article>", "<div>").replace("</article>", "</div>") for p in pages]
    for page in pages + cut:
        for window in (1, 3, 5):
            assert html_text.main_text(page, window) == by_windows(page, window)


def test_pages(spark):
    rows = [(1, "u", "<p>x</p>", "clash"), (1, "u", "<p>x</p>", "clash"), (None, None, None, None)]
    found = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert by_row(found, "page_id", "text", "n_chars") == sorted([(1, "x", 1), (1, "x", 1), (None, "", 0)], key=repr)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- exact and near duplicates -----------------------------------------------------------


def test_exact_dedup(docs, none, spark):
    groups = defaultdict(list)
    for r in corpus.rows():
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0]))
    found = exact_dedup.exact_dedup(docs).collect()
    wanted = [(x[2], min(g)[2], len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for x in g]
    assert sorted(wanted, key=repr) == sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found), key=repr)
    assert sum(r["kept"] for r in found) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in found if r["kept"])
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_dedup_is_native(docs):
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_near_duplicates(docs, none):
    marks = [corpus.simhash(r[1]) for r in corpus.rows()]
    wanted = [(r[0], f"{m:016x}", c) for r, m, c in zip(corpus.rows(), marks, corpus.classes(marks, [r[0] for r in corpus.rows()]))]
    assert by_row(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(wanted, key=repr)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("bits,most", [(4, 4_000_000), (7, 4_000_000), (4, 3000), (12, 50)])
def test_links_lose_no_class(spark, bits, most, monkeypatch):
    """Crowded random fingerprints around centres; chains and edges at exactly four bits."""
    monkeypatch.setattr(simhash, "_VARIANTS", most)
    rng = random.Random(bits)
    marks = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(25):
            x = centre
            for b in rng.sample(range(64), rng.randrange(0, 7)):
                x ^= 1 << b
            marks.add(x)
    marks = sorted(marks)
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    if most < 4_000_000:  # the same in this process, where the bound is as set
        a, b = simhash._stars(np.array(marks, np.uint64), 0, 64)
        parent = {m: m for m in marks}
        for x, y in zip(a.tolist(), b.tolist()):
            assert (x ^ y).bit_count() >= 1
            parent[y] = min(parent[y], x)
        assert [parent[m] for m in marks] == corpus.classes(marks, marks)
        return
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(m,) for m in signed], "fingerprint long"), bits)).collect()}
    found = [roots.get(m, m) for m in signed]
    assert found == corpus.classes(marks, signed)


# ---- classifier --------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    x, first, y = rng.random((9, quality.FEATURES)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = quality.Model.start(rng)
    loss = lambda: float(-np.mean(y * np.log(p := model.forward(x, first)["p"]) + (1 - y) * np.log(1 - p)))
    for name, grad in model.gradients(x, first, y).items():
        at = tuple(rng.integers(0, s) for s in grad.shape)
        model.w[name][at] += 1e-5
        up = loss()
        model.w[name][at] -= 2e-5
        down = loss()
        model.w[name][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(grad[at], abs=1e-6)


def test_long_texts_are_scored_whole(monkeypatch):
    """Scores in parts are those of the whole where parts end between words; the end of a text counts."""
    import pyarrow as pa

    rng = np.random.default_rng(1)
    model = quality.Model.start(rng)
    line = " ".join(f"word{i % 61}" for i in range(85))
    texts = ["", (line[:511] + " ") * 9, "short", (line[:511] + " ") * 8 + "@ " * 256]
    data, off = textops.utf8(pa.array(texts))
    whole = quality._score(model, data, off)
    monkeypatch.setattr(quality, "_STEP", 2 * quality.PASSAGE)
    assert quality._score(model, data, off) == pytest.approx(whole, abs=1e-6)
    assert whole[1] != whole[3]


def test_classifier_on_held_out_rows(spark, none):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = entries.op6_quality_classifier(spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.97
    assert sum(r["predicted"] == 0 and r["quality"] == 1 for r in rows) <= 3
    model = quality.learn(docs.limit(0), labels)
    odd = spark.createDataFrame(corpus.rows(), corpus.SCHEMA)
    assert all(r["score"] == 0.5 and r["predicted"] == 1 for r in quality.score(odd, model).collect())
    assert quality.score(none, model).count() == 0 and quality.keep_good(odd, model).count() == len(corpus.rows())


# ---- mixing ------------------------------------------------------------------------------


def test_shares():
    assert mixing.shares([("b", 100), ("a", 100), (None, 100)]) == {"a": 200.0, "b": 250 / 3, None: pytest.approx(500 / 3)}
    assert mixing.shares([("a", 0), ("b", 10)]) == {"a": 0.0, "b": 15.0}
    assert mixing.shares([]) == {} and mixing.shares([("a", 5)]) == {"a": 7.5}


def test_mix(docs, none, spark):
    rows = mixing.mix(docs).collect()
    sizes = Counter()
    for r in corpus.rows():
        sizes[r[3]] += len(corpus.WORD.findall(r[1] or ""))
    target = mixing.shares(list(sizes.items()))
    assert sorted(r["size"] for r in rows) == sorted(len(corpus.WORD.findall(r[1] or "")) for r in corpus.rows())
    assert all(0 <= r["taken"] <= 2 * r["size"] and 0 <= r["copies"] <= 2 for r in rows)
    got = Counter()
    for r in rows:
        got[r["source_size"], r["target"]] += r["taken"]
    assert all(abs(n - t) <= 2 for (_, t), n in got.items())
    assert sorted({(r["source_size"], r["target"]) for r in rows}) == sorted({(sizes[s], t) for s, t in target.items()})
    assert by_row(mixing.mix(docs), "doc_id", "taken") == by_row(mixing.mix(docs.repartition(3)), "doc_id", "taken")
    assert mixing.mix(none).count() == 0 and mixing.mixed(none).columns == none.columns
    even = spark.createDataFrame([(i, "w " * (1 + i % 7), f"s{min(i % 9, 5)}") for i in range(20000)], "doc_id long, text string, source string")
    got = Counter()
    want = {}
    for r in mixing.mix(even).join(even.select("doc_id", "source"), "doc_id").collect():
        got[r["source"]] += r["taken"]
        want[r["source"]] = r["target"]
    assert all(abs(got[s] - want[s]) <= 1 for s in want)
    assert mixing.mixed(even).count() == mixing.mix(even).groupBy().sum("copies").first()[0]


def test_thresholds_agree_with_sorting_by_hash(spark):
    """Taken words are those of the documents in order of their hash, up to the budget, the last one in part."""
    rng = random.Random(4)
    data = [(i, "w " * rng.choice([0, 1, 3, 40, 3000 if i % 97 == 0 else 7]), rng.choice(["a", "b", "b", "b", None])) for i in range(700)]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    from pyspark.sql import functions as F

    rows = mixing.mix(docs).join(docs.select("doc_id", "source", F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(1 << 30)).alias("hash")), "doc_id").collect()
    for source in ("a", "b", None):
        own = sorted((r for r in rows if r["source"] == source), key=lambda r: r["hash"])
        size, target = sum(r["size"] for r in own), own[0]["target"]
        whole = int(target // size)
        left = target - whole * size
        for r in own:
            more = min(r["size"], max(0, left)) if whole < 2 else 0
            assert abs(r["taken"] - whole * r["size"] - more) <= 0.5 + 1e-6, r
            left -= r["size"]


# ---- media and token files ---------------------------------------------------------------


def test_media_round_trip(docs, none):
    found = by_row(media.describe(media.store(docs)), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes")
    wanted = []
    for r in corpus.rows():
        raw = (r[1] or "").encode()
        pay = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        wanted.append((r[0], len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]), len(media.to_wav(pay))))
    assert found == sorted(wanted, key=repr)
    same = defaultdict(set)
    for r in media.describe(media.store(docs)).collect():
        same[r["payload_sha256"]].add((r["feature"], r["media_sha256"], tuple(r["landmarks"])))
    assert all(len(x) == 1 for x in same.values())
    assert media.describe(media.store(none)).count() == 0


def test_peaks_find_a_tone():
    wave_ = (128 + 100 * np.sin(2 * np.pi * 20 / 192 * np.arange(192 * 20))).astype(np.uint8)
    assert set(media.peaks(wave_).tolist()) == {20}
    marks = media.landmarks(media.peaks(wave_))
    assert set((marks & 0xFFFF) >> 9) == {20} and (np.diff(marks >> 16) >= 0).all()


def test_features_agree_with_sums_written_out(spark):
    """Peaks by the Fourier sums themselves, pairs and minimum hashes by plain loops."""
    texts = ["", "abc", "to and fro " * 70, "".join(chr(33 + (i * i) % 90) for i in range(700))]
    rows = {r["doc_id"]: r for r in media.describe(media.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    angle = 2 * np.pi / 192
    window = [0.5 - 0.5 * math.cos(2 * math.pi * (i + 1) / 193) for i in range(192)]
    for i, text in enumerate(texts):
        raw = text.encode()
        pay = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        peaks = []
        for at in range(0, len(pay) - 191, 96):
            frame = np.array([(b - 128) * w for b, w in zip(pay[at : at + 192], window)])
            power = [abs(sum(frame * np.exp(-1j * angle * k * np.arange(192)))) ** 2 for k in range(1, 97)]
            steps = [round(math.log2(p + 1) * 64) for p in power]
            peaks.append(1 + max(range(96), key=lambda k: (steps[k], -k)))
        marks = sorted(t << 16 | peaks[t] << 9 | peaks[t + d] << 2 | d for d in (1, 2, 3) for t in range(len(peaks) - d))
        assert rows[i]["landmarks"] == marks
        low = [min(((m & 0xFFFF) + 1) * k % (1 << 32) for m in marks) if marks else 0xFFFFFFFF for k in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]
        assert rows[i]["feature"] == f"{len(peaks)}:{len(marks)}:" + "".join(f"{x:08x}" for x in low)


def test_token_counts_across_blocks(docs, none):
    flat = token_counts.write_flat(docs, VOCABULARY, 50256, block_tokens=64)
    got = token_counts.count_tokens(flat, 50256)
    wanted = [(r[0], len(x)) for r, x in zip(corpus.rows(), library_ids([r[1] for r in corpus.rows()], special=False))]
    assert by_row(got, "doc_id", "n_tokens") == sorted(wanted, key=repr)
    assert token_counts.write_flat(none, VOCABULARY, 50256).count() == 0


def test_flat_files_of_any_shape(spark, tmp_path):
    files = {"a.bin": [5, 6, 0, 0, 7, 0], "b.bin": [1, 2, 3], "c.bin": [0], "d.bin": [1] * 700 + [0] + [2] * 300, "e.bin": [0] * 9}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    for size in (2, 6, 64, 4096):
        rows = token_counts.count_tokens(token_counts.read_flat(spark, str(tmp_path), size), 0).collect()
        got = defaultdict(list)
        for r in sorted(rows, key=lambda r: r["ordinal"]):
            got[r["file"].split("/")[-1]].append((r["n_tokens"], r["ended"]))
        assert got == {"a.bin": [(2, True), (0, True), (1, True)], "b.bin": [(3, False)], "c.bin": [(0, True)], "d.bin": [(700, True), (300, False)], "e.bin": [(0, True)] * 9}


# ---- odd names ---------------------------------------------------------------------------


def test_stages_keep_columns_of_any_name(spark):
    """Columns named like those that operators might make for themselves come back as they were."""
    import corpus_pipeline

    names = ["__sha", "__n", "__row", "__id", "__copies", "__copy", "rid", "row", "group", "id", "n", "size", "hash", "fingerprint", "a.b"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x}` string" for x in names)
    data = [(i, " ".join(f"w{(i % 4) * 31 + j}" for j in range(12)), "en", f"s{i % 2}", 5, *(f"{x}-{i}" for x in names)) for i in range(12)]
    rows = spark.createDataFrame(data, schema)
    model = quality.learn(rows.limit(0), spark.createDataFrame([], "doc_id long, quality int"))
    for f in (exact_dedup.keep_one, simhash.keep_one, mixing.mixed, lambda d: quality.keep_good(d, model)):
        out = f(rows)
        assert out.columns == rows.columns
        for r in out.collect():
            assert list(r)[5:] == [f"{x}-{r['doc_id']}" for x in names]
    assert exact_dedup.keep_one(rows).count() == 4
    assert len(corpus_pipeline.STAGES) == 5
