"""Language identification by a byte-level convolutional network.

Filters of several widths slide over the bytes of fixed-length windows; each filter's maximum over the window goes through a
dense layer and softmax. A filter over discrete bytes is a sum of one table row per position, so tables of byte pairs, made
once after training, answer a width of 4 with two look-ups per position. The whole text is read, in windows of WINDOW bytes
without overlap; the text's distribution is the softmax of the windows' mean log-probabilities, weighted by their bytes.

Training is numpy on the driver, from a sample of at most SAMPLE rows, spread evenly over the languages and drawn by hash over
all labelled rows; of each row one window at a hashed place. Every label is learned, however rare: with more labels than SAMPLE
the sample is one row of each. Its size and the number of labels are the bound on what the driver holds.

Defined cases: null texts and texts without a letter are `und` with score 1.0. With no labelled row at all everything is
`und` with score 0.0. Other columns are ignored, repeated rows give repeated results, no rows give none.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordvane.llm.common import hash01, in_small_batches, local_rows

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Rows that the classifier is fitted on, at most, but for one of each language.
SAMPLE = 6000
SHORTEST_TRAINING_BYTES = 8
EPOCHS = 14
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def training_sample(documents: DataFrame, size: int = SAMPLE) -> list[tuple[str, bytes]]:
    """(lang, bytes of one window) of at most `size` labelled rows that aren't held out, as many of each language where there are, one at least."""
    rows = documents.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id"))).select("lang", "text", "doc_id")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return []
    each = max(1, size // len(counts))
    most = max(1.2 * each, each + 4 * each**0.5 + 12)
    shares = local_rows(rows.sparkSession, [(lang, min(1.0, most / n)) for lang, n in counts.items()], "lang string, share double")
    place = hash01(F.col("doc_id"), seed="place")
    length = F.length("text")
    at = (F.floor(place * F.greatest(F.lit(1), length - F.lit(WINDOW))) + 1).cast("int")
    window = F.substr("text", at, F.lit(WINDOW))
    spot = hash01(F.col("doc_id"), seed="sample")
    spots = rows.select("lang", window.alias("window"), spot.alias("spot"), "doc_id")
    drawn = spots.join(F.broadcast(shares), "lang").where("spot < share")  # a row of a label and a number per language
    taken = {lang: 0 for lang in counts}
    out = []
    found = drawn.orderBy("spot", "doc_id", "lang").limit(max(2 * size, int(2 * most * len(counts)))).collect()
    if missed := sorted(set(counts) - {r["lang"] for r in found}):
        first = spots.join(F.broadcast(local_rows(rows.sparkSession, [(lang,) for lang in missed], "lang string")), "lang")
        found += first.groupBy("lang").agg(F.min(F.struct("spot", "doc_id", "window")).alias("r")).select("lang", "r.window").orderBy("lang").collect()
    for r in found:
        if taken[r["lang"]] < each:
            taken[r["lang"]] += 1
            out.append((r["lang"], r["window"].encode("utf-8", "replace")[:WINDOW]))
    return out


def window_matrix(parts: list[bytes]) -> np.ndarray:
    """Windows as rows of bytes, short ones filled up with zero bytes."""
    out = np.zeros((len(parts), WINDOW), np.uint8)
    for row, part in zip(out, parts, strict=True):
        row[: len(part)] = np.frombuffer(part, np.uint8)
    return out


class ByteCNN:
    """tables[w][k]: what byte b at place k of a filter of width w adds to each filter (256 x FILTERS)."""

    def __init__(self, languages: list[str], tables: dict[int, np.ndarray], dense: np.ndarray, bias: np.ndarray):
        self.languages, self.tables, self.dense, self.bias = languages, tables, dense, bias
        self.pairs: dict[int, list[np.ndarray]] = {}

    def prepare(self) -> None:
        """Tables of byte pairs: a filter of width w is a sum of ceil(w / 2) of them."""
        for w, table in self.tables.items():
            self.pairs[w] = [(table[k][:, None, :] + table[k + 1][None, :, :]).reshape(65536, -1) if k + 1 < w else table[k] for k in range(0, w, 2)]

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Maxima of all filters over each window, after a rectifier."""
        single = windows.astype(np.int32)
        double = (single[:, :-1] << 8) | single[:, 1:]
        out = []
        for w in WIDTHS:
            last = WINDOW - w + 1
            total = None
            for j, table in enumerate(self.pairs[w]):
                k = 2 * j
                index = double[:, k : k + last] if table.shape[0] == 65536 else single[:, k : k + last]
                add = table.take(index, axis=0)
                total = add if total is None else np.add(total, add, out=total)
            out.append(total.max(axis=1))
        return np.maximum(np.concatenate(out, axis=1), 0)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        z = self.pooled(windows) @ self.dense + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def predict(self, texts: list[bytes], batch: int = 32) -> tuple[list[str], np.ndarray]:
        """Language and its probability for each text of at least one byte."""
        n = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
        owner = np.repeat(np.arange(len(texts)), n)
        sums, weight = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        flat = np.zeros((int(n.sum()), WINDOW), np.uint8).reshape(-1)
        begin = (np.concatenate([[0], np.cumsum(n)[:-1]]) * WINDOW).tolist()
        for at, t in zip(begin, texts, strict=True):
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        windows = flat.reshape(-1, WINDOW)
        for at in range(0, len(windows), batch):
            own = owner[at : at + batch]
            part = windows[at : at + batch]
            used = np.count_nonzero(part, axis=1).astype(float)
            np.add.at(sums, own, self.log_probabilities(part) * used[:, None])
            np.add.at(weight, own, used)
        z = sums / np.maximum(weight, 1)[:, None]
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[i] for i in best], p[np.arange(len(p)), best]


def train(sample: list[tuple[str, bytes]], epochs: int = EPOCHS, seed: int = 7) -> ByteCNN:
    """Adam on cross-entropy. The gradient of a maximum goes to the bytes of its place alone. Half of the windows of each step are cut
    short, so that short texts are met too."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in sample})
    number = {lang: i for i, lang in enumerate(languages)}
    y_all = np.array([number[lang] for lang, _ in sample])
    parts = [p for _, p in sample]
    x_all, lengths = window_matrix(parts), np.array([len(p) for p in parts])
    tables = {w: rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
    for table in tables.values():
        table[:, 0, :] = 0
    dense = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    params = [*tables.values(), dense, bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, size = 0, 64
    for epoch in range(epochs):
        order = rng.permutation(len(x_all))
        for at in range(0, len(order), size):
            rows = order[at : at + size]
            x, y = x_all[rows].copy(), y_all[rows]
            for i in np.flatnonzero(rng.random(len(rows)) < 0.5):
                keep = int(rng.integers(SHORTEST_TRAINING_BYTES, max(SHORTEST_TRAINING_BYTES + 1, lengths[rows[i]] + 1)))
                x[i, keep:] = 0
            single = x.astype(np.int32)
            pooled, places = [], []
            for w, table in tables.items():
                last = WINDOW - w + 1
                total = sum(table[k].take(single[:, k : k + last], axis=0) for k in range(w))
                where = total.argmax(axis=1)
                places.append(where)
                pooled.append(np.take_along_axis(total, where[:, None, :], axis=1)[:, 0, :])
            raw = np.concatenate(pooled, axis=1)
            h = np.maximum(raw, 0)
            z = h @ dense + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ dense.T) * (raw > 0)
            grads = []
            for j, (w, table) in enumerate(tables.items()):
                g = np.zeros_like(table)
                part = back[:, j * FILTERS : (j + 1) * FILTERS]
                column = np.broadcast_to(np.arange(FILTERS), places[j].shape)
                for k in range(w):
                    byte = np.take_along_axis(single, places[j] + k, axis=1)
                    np.add.at(g[k], (byte.ravel(), column.ravel()), part.ravel())
                g[:, 0, :] = 0  # filling is no evidence
                grads.append(g)
            grads += [h.T @ p + 1e-4 * dense, p.sum(axis=0)]
            step += 1
            rate = 0.01 * (0.3 if epoch >= epochs * 2 // 3 else 1.0)
            for value, g, m, v in zip(params, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ByteCNN(languages, tables, dense, bias)


def has_letter(text: str | None) -> bool:
    return next(filter(str.isalpha, text or ""), None) is not None


def predict(documents: DataFrame, model: ByteCNN | None, replace: bool = False, least: float = 0.0) -> DataFrame:
    """documents with lang_pred and score; columns of these names in the input are replaced.

    replace: instead, the columns of documents with the prediction as `lang`, of the texts with letters and scores of `least` or more.
    One Arrow operator does both: a filter on the outcome of a column function would be pushed below it and run the network twice.
    """
    keep = documents.columns if replace else [c for c in documents.columns if c not in ("lang_pred", "score")]
    base = in_small_batches(documents).select(*[F.col(f"`{c}`") for c in keep])
    if model is None:
        return base.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    schema = T.StructType([T.StructField(c, T.StringType()) if replace and c == "lang" else base.schema[c] for c in keep])
    if not replace:
        schema = schema.add("lang_pred", T.StringType()).add("score", T.DoubleType())

    def classify(batches):
        import pyarrow as pa

        if not model.pairs:
            model.prepare()
        for batch in batches:
            texts = batch.column(keep.index("text"))
            langs, scores, lettered = [UNKNOWN] * batch.num_rows, np.ones(batch.num_rows), np.zeros(batch.num_rows, bool)
            for at in range(0, batch.num_rows, 64):
                some = texts.slice(at, 64).to_pylist()
                rows = [i for i, t in enumerate(some) if has_letter(t)]
                if rows:
                    found, p = model.predict([some[i].encode("utf-8", "replace") for i in rows])
                    for i, lang, x in zip(rows, found, p.tolist(), strict=True):
                        langs[at + i], scores[at + i], lettered[at + i] = lang, x, True
            lang = pa.array(langs, pa.string())
            columns = list(batch.columns)
            if replace:
                columns[keep.index("lang")] = lang
                good = pa.array(lettered & (scores >= least))
                yield pa.RecordBatch.from_arrays(columns, names=keep).filter(good)
            else:
                yield pa.RecordBatch.from_arrays([*columns, lang, pa.array(scores)], names=[*keep, "lang_pred", "score"])

    return base.mapInArrow(classify, schema)


def fitted(documents: DataFrame, size: int = SAMPLE) -> ByteCNN | None:
    sample = training_sample(documents, size)
    return train(sample) if sample else None


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of `documents`."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict(documents.select("doc_id", "text"), fitted(documents))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
