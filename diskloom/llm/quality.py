"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages (windows of its bytes, the whole text).  Each passage is
encoded from its own form: how often each pair of neighbouring character classes occurs,
how long its words are and how many of them repeat.  Gated attention weights, learned
from document labels alone, sum the encoded passages to one representation, and a
logistic unit scores it.  Source, language, ids and labels are never inputs of a score.

The model is fitted on the driver from a bounded sample of labelled rows: the
``sample`` rows (of at most ``sample_bytes`` of text each) with the smallest hash of id.
Everything is scored, in one pass without a shuffle; the model is a few thousand numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops

PASSAGE = 512
_CLASSES = 18


def _classes() -> np.ndarray:
    """A class for every byte; the classes are fixed values."""
    kind = np.full(256, 17, np.int64)
    kind[97:123], kind[65:91], kind[48:58], kind[128:192], kind[192:] = 0, 1, 2, 3, 4
    for number, members in enumerate([b" ", b"\n\r", b"\t\x0b\x0c", b".", b",", b"|", b"!?", b"%$#&*~^", b"'\"`()[]{}<>", b"-_=+/\\", b":;", b"@"], 5):
        kind[list(members)] = number
    return kind


_KIND = _classes()
FEATURES = _CLASSES * _CLASSES + 4


def encode(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Passage features (float32) and the first passage of each row (one more at the end).

    Every row has one passage at least; an empty text has one of zeros.
    """
    sizes = np.diff(off)
    many = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate(([0], np.cumsum(many)))
    total = int(first[-1])
    if not len(data):
        return np.zeros((total, FEATURES), np.float32), first
    row = np.repeat(np.arange(len(sizes)), sizes)
    of = first[row] + (np.arange(len(data)) - off[row]) // PASSAGE
    kind = _KIND[data]
    pair = (of[:-1] * _CLASSES + kind[:-1]) * _CLASSES + kind[1:]
    same = of[:-1] == of[1:]
    grid = np.bincount(pair[same], minlength=total * _CLASSES * _CLASSES).reshape(total, -1).astype(np.float32)
    held = np.bincount(of, minlength=total).astype(np.float32)
    starts, ends, _ = textops.words(data, off)
    extra = np.zeros((total, 4), np.float32)
    if len(starts):
        place, long_ = of[starts], ends - starts
        n = np.bincount(place, minlength=total)
        low = textops.LOWER[data[textops.ragged(starts, long_)]]
        word = textops.binary_array(low, np.concatenate(([0], np.cumsum(long_)))).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        distinct = np.bincount(np.unique(place * (int(word.max()) + 1) + word) // (int(word.max()) + 1), minlength=total)
        some = np.maximum(n, 1)
        extra[:, 0] = distinct / some
        extra[:, 1] = np.bincount(place, long_, minlength=total) / some / 8
        extra[:, 2] = np.bincount(place, long_ > 12, minlength=total) / some
    extra[:, 3] = held / PASSAGE
    return np.concatenate([np.sqrt(grid / np.maximum(held, 1)[:, None]), extra], axis=1), first


class Model:
    """Passage encoder, gated attention and the bag's logistic unit."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @staticmethod
    def start(rng: np.random.Generator, width: int = 24, gate: int = 12) -> "Model":
        small = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        return Model({"E": small(FEATURES, width), "e": np.zeros(width), "V": small(width, gate), "U": small(width, gate), "a": small(gate, 1), "c": small(width, 1), "b": np.zeros(1), "mean": np.zeros(FEATURES), "scale": np.ones(FEATURES)})

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Encoded passages, both halves of their gates, and their attention before it is shared out."""
        w = self.w
        plain = w["E"] / w["scale"][:, None]  # features are scaled by the weights instead of one by one
        z = np.tanh(x.astype(np.float64) @ plain + (w["e"] - w["mean"] @ plain))
        v, u = np.tanh(z @ w["V"]), 1 / (1 + np.exp(-(z @ w["U"])))
        return z, v, u, ((v * u) @ w["a"])[:, 0]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        z, v, u, s = self.passages(x)
        return {"z": z, "v": v, "u": u} | self.bags(z, s, first)

    def bags(self, z: np.ndarray, s: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        """Weighted sums of encoded passages, and the probabilities of their bags."""
        w, starts = self.w, first[:-1]
        bag = np.repeat(np.arange(len(starts)), np.diff(first))
        raw = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        alpha = raw / np.add.reduceat(raw, starts)[bag]
        m = np.add.reduceat(alpha[:, None] * z, starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip((m @ w["c"])[:, 0] + w["b"][0], -30, 30)))
        return {"alpha": alpha, "m": m, "p": p, "bag": bag}

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.w, self.forward(x, first)
        bag, starts = f["bag"], first[:-1]
        d = (f["p"] - y) / len(y)
        dm = d[:, None] * w["c"][:, 0][None, :]
        dz = f["alpha"][:, None] * dm[bag]
        da = (dm[bag] * f["z"]).sum(1)
        ds = f["alpha"] * (da - np.add.reduceat(f["alpha"] * da, starts)[bag])
        dh = ds[:, None] * w["a"][:, 0][None, :]
        dv, du = dh * f["u"] * (1 - f["v"] ** 2), dh * f["v"] * f["u"] * (1 - f["u"])
        dz = dz + dv @ w["V"].T + du @ w["U"].T
        de = dz * (1 - f["z"] ** 2)
        scaled = (x - w["mean"]) / w["scale"]
        return {"E": scaled.T @ de, "e": de.sum(0), "V": f["z"].T @ dv, "U": f["z"].T @ du, "a": ((f["v"] * f["u"]).T @ ds)[:, None], "c": f["m"].T @ d[:, None], "b": np.array([d.sum()])}


def fit(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 14, batch: int = 64, rate: float = 4e-3, decay: float = 2e-4, seed: int = 7) -> Model:
    """Adam on the logistic loss of the bags; the same rows in the same order give the same model."""
    rng = np.random.default_rng(seed)
    model = Model.start(rng)
    model.w["mean"], model.w["scale"] = x.mean(0).astype(np.float64), x.std(0) + 0.02
    rate_pos = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    model.w["b"][0] = np.log(rate_pos / (1 - rate_pos))
    names = ["E", "e", "V", "U", "a", "c", "b"]
    one, two = ({k: np.zeros_like(model.w[k]) for k in names} for _ in range(2))
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            pick = order[lo : lo + batch]
            n = np.diff(first)[pick]
            xs = x[textops.ragged(first[pick], n)].astype(np.float64)
            g = model.gradients(xs, np.concatenate(([0], np.cumsum(n))), y[pick])
            step += 1
            pace = rate * (1 - 0.9 * epoch / max(1, epochs - 1))
            for k in names:
                grad = g[k] + decay * model.w[k] * (k not in "eb")
                one[k] = 0.9 * one[k] + 0.1 * grad
                two[k] = 0.999 * two[k] + 0.001 * grad**2
                model.w[k] = model.w[k] - pace * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: str, folds: int = 5):
    """True for rows whose crc32 of the id as text leaves no remainder; null ids count as the text ''."""
    return (F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % folds) == 0


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 4000, sample_bytes: int = 65536, folds: int = 5) -> Model:
    """Fit on the labelled rows that are not held out (see the module for the sample).

    A label that is null is ignored; an id with several labels counts by its largest; with
    no labelled row the model knows nothing and scores one half.
    """
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y")).where("__y is not null").groupBy("__id").agg(F.max("__y").alias("__y"))
    sized = docs.where(~held_out(id_col, folds)).select(F.col(id_col).alias("__id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("__size"))
    chosen = (
        sized.where(F.col("__size") <= sample_bytes).join(known, "__id")
        .select("__id", "__y", F.xxhash64("__id").alias("__h")).distinct().orderBy("__h", "__id").limit(sample)
    )
    # At most ``sample`` rows of two numbers: the texts stay where they are.
    picked = chosen.collect()
    few = docs.sparkSession.createDataFrame([(r["__id"], r["__y"], r["__h"]) for r in picked], chosen.schema)
    rows = (
        docs.where(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) <= sample_bytes)
        .select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text")).join(F.broadcast(few), "__id")
        .select(F.col("__h").alias("h"), F.col("__id").alias("id"), F.col("__text").alias("text"), F.col("__y").alias("y"))
        .orderBy("h", "id", "text").limit(sample).toArrow()
    )
    if not rows.num_rows:
        model = Model.start(np.random.default_rng(0))
        model.w["c"][:] = 0
        return model
    parts = [encode(*textops.utf8(part.column("text"))) for batch in rows.to_batches() for part in textops.pieces(batch, "text", 1 << 18)]
    counts = np.concatenate([np.diff(first) for _, first in parts])
    return fit(np.concatenate([x for x, _ in parts]), np.concatenate(([0], np.cumsum(counts))), rows.column("y").to_numpy())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row's whole text.

    Null and empty texts are one passage without characters; long texts are read whole;
    equal texts score equally; repeated rows are scored each; null ids stay null; an empty
    table gives an empty table; further columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.pieces(batch, "text", 1 << 20):
                p = _score(model, *textops.utf8(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, folds).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


#: Bytes of a text that are encoded at once; words end there.
_STEP = 2048 * PASSAGE


def _score(model: Model, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    sizes = np.diff(off)
    if len(sizes) and int(sizes.max()) > _STEP:  # encoded in parts, as its passages fit where their features do not
        many, kept = [], []
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            parts = [model.passages(encode(data[lo : min(lo + _STEP, b)], np.array([0, min(lo + _STEP, b) - lo]))[0]) for lo in range(a, max(b, a + 1), _STEP)]
            kept += [(z, s) for z, _, _, s in parts]
            many.append(sum(len(x[3]) for x in parts))
        z, s = (np.concatenate(x) for x in zip(*kept))
        return np.round(model.bags(z, s, np.concatenate(([0], np.cumsum(many))))["p"], 9)
    # Rounded, as sums over a batch may differ in the last place from batch to batch.
    return np.round(model.forward(*encode(data, off))["p"], 9)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not reject.

    Null and empty texts are scored like one passage without characters; long texts are
    read whole; repeated rows are judged alike; an empty table gives an empty table; columns
    may have any names.
    """
    own = f"c{docs.columns.index(text_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textops.pieces(batch, own, 1 << 20):
                yield part.filter(pa.array(_score(model, *textops.utf8(part.column(own))) >= threshold))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
