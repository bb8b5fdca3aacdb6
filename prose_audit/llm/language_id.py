"""Language ID by a byte convolutional network.

Windows of WINDOW bytes pass filters of widths 2, 3 and 4 over byte embeddings, a ReLU, max pooling over
the window and a softmax. The network is trained in numpy on the driver, on a bounded sample of labelled
texts. To apply it, embeddings and filters are multiplied out into tables by byte and by pair of bytes, so
that a filter's response is a sum of table rows; windows are stacked in batches. A text's prediction is
that of the summed log-probabilities of its windows, which cover all of it.

Defined cases: a null text, or one without a letter, is ``und`` with score and odds 0; a language is any label in
the training rows; without training rows every text is ``und``; equal texts get equal predictions; null
labels are never learned from. Other columns pass through unless their names clash with the result's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import arrow_schema, map_batches

#: Texts of each language to learn from: the bound of the training sample. Of each, so many windows.
SAMPLE_TEXTS, SAMPLE_WINDOWS = 400, 3
WINDOW, EMBEDDING, FILTERS, WIDTHS = 128, 8, 16, (2, 3, 4)
EPOCHS, BATCH, RATE = 12, 64, 0.01
#: Table entries are fixed-point numbers with this many steps to 1.
STEPS = 512.0
NO_LANGUAGE = "und"
#: Windows that go through the network at once.
BATCH_WINDOWS = 2048


def windows(data: bytes) -> np.ndarray:
    """The bytes in rows of WINDOW, the last one filled up with zeros."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    """Parameters of the network for ``labels``, trained by Adam."""

    def __init__(self, labels: list[str], seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBEDDING)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))), "bias": np.zeros(len(labels))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _spread(self, x: np.ndarray, w: int) -> np.ndarray:
        e = self.p["embed"][x]
        n = WINDOW - w + 1
        return np.concatenate([e[:, k : k + n] for k in range(w)], axis=2)

    def train(self, x: np.ndarray, y: np.ndarray, seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), BATCH):
                own = order[at : at + BATCH]
                step += 1
                for k, g in self._gradients(x[own], y[own]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    rate = RATE * 0.5 ** (epoch / 4)
                    self.p[k] -= (rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        n, rows = len(x), np.arange(len(x))[:, None]
        kept, pooled = {}, []
        for w in WIDTHS:
            spread = self._spread(x, w)
            response = spread @ self.p[f"w{w}"] + self.p[f"b{w}"]
            best = response.argmax(1)
            top = response[rows, best, np.arange(FILTERS)]
            kept[w] = (spread, best, top > 0)
            pooled.append(np.maximum(top, 0))
        hidden = np.concatenate(pooled, 1)
        logits = hidden @ self.p["out"] + self.p["bias"]
        prob = np.exp(logits - logits.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        prob[np.arange(n), y] -= 1
        prob /= n
        grad = {"out": hidden.T @ prob, "bias": prob.sum(0), "embed": np.zeros_like(self.p["embed"])}
        back = prob @ self.p["out"].T
        for k, w in enumerate(WIDTHS):
            spread, best, on = kept[w]
            own = back[:, k * FILTERS : (k + 1) * FILTERS] * on
            chosen = spread[rows, best]  # window, filter, width times embedding
            grad[f"w{w}"] = np.einsum("nfd,nf->df", chosen, own)
            grad[f"b{w}"] = own.sum(0)
            into = np.einsum("nf,df->nfd", own, self.p[f"w{w}"]).reshape(n, FILTERS, w, EMBEDDING)
            for j in range(w):
                np.add.at(grad["embed"], x[rows, best + j], into[:, :, j])
        return grad

    def tables(self) -> dict:
        """The network multiplied out: per width, tables of pairs or single bytes with their offsets."""
        out = {"labels": self.labels, "out": self.p["out"], "bias": self.p["bias"], "conv": []}
        for w in WIDTHS:
            by_byte = [self.p["embed"] @ self.p[f"w{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)]
            parts, j = [], 0
            while j < w:
                if j + 1 < w:
                    t = (by_byte[j][:, None, :] + by_byte[j + 1][None, :, :]).reshape(1 << 16, FILTERS)
                    parts.append((j, True, np.clip(np.rint(t * STEPS), -8000, 8000).astype(np.int16)))
                    j += 2
                else:
                    parts.append((j, False, np.clip(np.rint(by_byte[j] * STEPS), -8000, 8000).astype(np.int16)))
                    j += 1
            out["conv"].append((w, parts, self.p[f"b{w}"]))
        return out


def log_probabilities(tables: dict, x: np.ndarray) -> np.ndarray:
    """Of each window (a row of bytes) the log-probability of each label."""
    pair = x[:, :-1].astype(np.uint16) << np.uint16(8) | x[:, 1:]
    hidden = []
    for w, parts, bias in tables["conv"]:
        n = WINDOW - w + 1
        total = None
        for j, double, table in parts:
            part = table.take((pair if double else x)[:, j : j + n], axis=0)
            total = part if total is None else np.add(total, part, out=total)
        hidden.append(np.maximum(total.max(1) / np.float32(STEPS) + bias, 0))
    logits = np.concatenate(hidden, 1) @ tables["out"] + tables["bias"]
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True))


def predict(tables: dict, texts: list[str | None]) -> tuple[list[str], list[float], list[float]]:
    """Label, score and odds of each text. The score is the geometric mean of its windows' probabilities,
    scaled to sum to 1 over the labels; the odds are the best label's score over the second best one's."""
    labels = [NO_LANGUAGE] * len(texts)
    scores, odds = [0.0] * len(texts), [0.0] * len(texts)
    own = [i for i, t in enumerate(texts) if t is not None and tables["labels"] and any(map(str.isalpha, t))]
    held, rows, n = [], [], 0

    def flush() -> None:
        nonlocal held, rows, n
        if not held:
            return
        x = np.concatenate(held)
        each = np.concatenate([log_probabilities(tables, x[a : a + BATCH_WINDOWS]) for a in range(0, len(x), BATCH_WINDOWS)])
        sizes = np.array([len(h) for h in held])
        mean = np.add.reduceat(each, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        prob = np.exp(mean - mean.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        second = np.sort(mean, axis=1)[:, -2] if mean.shape[1] > 1 else np.full(len(mean), -np.inf)
        ahead = np.exp(np.minimum(mean.max(1) - second, 700))
        for i, k, p, o in zip(rows, prob.argmax(1).tolist(), prob.max(1).tolist(), ahead.tolist()):
            labels[i], scores[i], odds[i] = tables["labels"][k], min(1.0, float(p)), o
        held, rows, n = [], [], 0

    for i in own:
        held.append(windows(texts[i].encode()))
        rows.append(i)
        n += len(held[-1])
        if n >= BATCH_WINDOWS:
            flush()
    flush()
    return labels, scores, odds


def held_out(doc_id: str = "doc_id", folds: int = 5) -> F.Column:
    """Whether crc32 of the doc_id as text leaves no remainder; null ids are held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(True))


def training_sample(labelled: DataFrame, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """lang and pieces (SAMPLE_WINDOWS windows of bytes, spread over the text) of ``texts`` different texts of each
    label at most, those with the smallest hash of the text. So the driver gets a few hundred bytes a row.

    A first pass counts each label's different texts; only those below a hash bound that leaves about twice as
    many as needed are ranked. Copies are one text and are combined before the shuffle, so no label and no group
    of copies is gathered whole.
    """
    own = labelled.select("text", F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null")
    own = own.withColumn("h", F.xxhash64("text", F.lit(11)))
    counts = own.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(2.0 * texts + 100) / F.col("n"))
    few = own.join(F.broadcast(counts), "lang").filter((F.col("h") / F.lit(2.0**64) + 0.5) <= share)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    data = F.col("text").cast("binary")
    last = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / WINDOW)) - 1

    def piece(i: int) -> F.Column:
        at = F.floor(last * i / max(1, SAMPLE_WINDOWS - 1)).cast("int") * WINDOW
        return F.substring(data, at + 1, F.lit(WINDOW))

    pieces = F.array_distinct(F.array(*map(piece, range(SAMPLE_WINDOWS))))
    one = few.select("lang", "h", pieces.alias("pieces")).groupBy("lang", "h").agg(F.min("pieces").alias("pieces"))
    return one.withColumn("rank", rank).filter(F.col("rank") <= texts).select("lang", "h", "rank", "pieces")


def train(labelled: DataFrame, texts: int = SAMPLE_TEXTS) -> dict:
    """Tables of a network trained on a bounded sample of ``labelled(text, lang)``."""
    sample = sorted(training_sample(labelled, texts).collect(), key=lambda r: (r.lang, r.rank))
    labels = sorted({r.lang for r in sample})
    if not labels:
        return {"labels": []}
    x, y = [], []
    for r in sample:
        for piece in r.pieces:
            x.append(windows(bytes(piece))[0])
            y.append(labels.index(r.lang))
    net = Network(labels)
    net.train(np.stack(x), np.array(y))
    return net.tables()


def identify(docs: DataFrame, tables: dict) -> DataFrame:
    """``docs`` with lang_pred, score and odds of each whole text. The model (16 filters, three widths) is 8 MB,
    whatever the input."""
    spark = docs.sparkSession
    keep = docs.drop("lang_pred", "score", "odds")
    ddl = "lang_pred string, score double, odds double"
    schema = StructType([*keep.schema.fields, *StructType.fromDDL(ddl).fields])
    added = arrow_schema(spark, ddl)
    at = keep.columns.index("text")
    model = spark.sparkContext.broadcast(tables)

    def run(batches):
        for batch in batches:
            got = predict(model.value, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, f.type) for v, f in zip(got, added))], names=[*batch.schema.names, *added.names])

    return map_batches(keep, run, schema)
