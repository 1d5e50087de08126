"""Language identification by a small convolutional network over bytes, trained in numpy on labelled documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.llm.runtime import bounded_batches, few, materialize, row_key, text_or_empty

#: Bytes of a window, filter widths, filters of each width, and size of a byte's vector.
WINDOW, WIDTHS, FILTERS, BYTE_DIMS = 256, (2, 3, 4), 12, 8
#: Training: documents drawn (about, over all languages alike), but no fewer of a language that has them; characters taken of each, rounds.
SAMPLE_DOCS, LEAST_DOCS, SAMPLE_CHARS, ROUNDS = 2400, 16, 1000, 4
#: Bytes that are convolved at once, and bytes of text that are windowed at once.
_STEP, _HELD = 1 << 14, 4 << 20
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteNet:
    """Byte vectors -> filters of several widths -> maximum over the window -> ReLU -> softmax over languages."""

    languages: list[str]
    vectors: np.ndarray  # BYTE_DIMS x 256; byte 0 pads and is zero
    filters: np.ndarray  # filters x (widest * BYTE_DIMS); narrower filters end in zeros
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 1) -> ByteNet:
        rng = np.random.default_rng(seed)
        n, wide = FILTERS * len(WIDTHS), max(WIDTHS)
        vectors = rng.normal(0, 0.5, (BYTE_DIMS, 256)).astype("f4")
        vectors[:, 0] = 0
        return cls(languages, vectors, (rng.normal(0, 0.3, (n, wide * BYTE_DIMS)) * cls._mask()).astype("f4"), np.zeros(n, "f4"), rng.normal(0, 0.2, (n, len(languages))).astype("f4"), np.zeros(len(languages), "f4"))

    @staticmethod
    def _mask() -> np.ndarray:
        return np.concatenate([np.repeat((np.arange(max(WIDTHS)) < w)[None, :], FILTERS, 0).repeat(BYTE_DIMS, 1) for w in WIDTHS]).astype("f4")

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        """(widest * BYTE_DIMS) x (windows * WINDOW): the vectors of each place and its followers."""
        flat = np.concatenate([windows.reshape(-1), np.zeros(max(WIDTHS) - 1, "u1")])
        every = self.vectors[:, flat]
        n = windows.size
        return np.concatenate([every[:, k : k + n] for k in range(max(WIDTHS))])

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cols = self._columns(windows)
        maps = (self.filters @ cols).reshape(len(self.filters), len(windows), WINDOW)[:, :, : WINDOW - max(WIDTHS) + 1]
        return maps, cols, np.maximum(maps.max(2).T + self.bias, 0)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        step = max(1, _STEP // WINDOW)
        parts = [self.pooled(windows[i : i + step])[2] @ self.out + self.out_bias for i in range(0, len(windows), step)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.languages)), "f4")

    def fit(self, windows: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS, rate: float = 0.01, seed: int = 2) -> ByteNet:
        """Adam on the cross entropy, in batches of 64 windows."""
        rng, names = np.random.default_rng(seed), ("vectors", "filters", "bias", "out", "out_bias")
        m, v, t, mask = {k: 0.0 for k in names}, {k: 0.0 for k in names}, 0, self._mask()
        wide = max(WIDTHS)
        for turn in range(rounds):
            order = rng.permutation(len(windows))
            for s in range(0, len(order), 64):
                x, y = windows[order[s : s + 64]], labels[order[s : s + 64]]
                maps, cols, h = self.pooled(x)
                p = h @ self.out + self.out_bias
                p = np.exp(p - p.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                dh = (p @ self.out.T) * (h > 0)
                at = maps.argmax(2).T + np.arange(len(x))[:, None] * WINDOW  # windows x filters
                seen = cols[:, at]  # (widest * dims) x windows x filters
                g = {"out": h.T @ p, "out_bias": p.sum(0), "bias": dh.sum(0), "filters": np.einsum("nf,dnf->fd", dh, seen) * mask}
                back = (dh[:, :, None] * self.filters[None]).reshape(len(x), -1, wide, BYTE_DIMS)
                flat = np.concatenate([x.reshape(-1), np.zeros(wide, "u1")])
                which = flat[at[:, :, None] + np.arange(wide)]
                grad = np.zeros((256, BYTE_DIMS), "f4")
                np.add.at(grad, which.reshape(-1), back.reshape(-1, BYTE_DIMS))
                grad[0] = 0
                g["vectors"] = grad.T
                t += 1
                for k in names:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    step = rate * 0.5**turn * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - step).astype("f4"))
        return self

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Language index and its probability for each text: the mean of its windows' logits, weighted by their bytes."""
        windows, first, fill = cut(texts)
        z = np.add.reduceat(self.logits(windows) * fill[:, None], first) / np.maximum(np.add.reduceat(fill, first), 1)[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All of each text in windows side by side, the last one padded; the first window of each text, and the bytes in each window."""
    sizes = np.fromiter(map(len, texts), "i8", len(texts))
    counts = np.maximum(1, -(-sizes // WINDOW))
    first = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(first[-1] * WINDOW, "u1")
    for t, f in zip(texts, first.tolist(), strict=False):
        flat[f * WINDOW : f * WINDOW + len(t)] = np.frombuffer(t, "u1")
    fill = np.full(first[-1], WINDOW, "f4")
    fill[first[1:] - 1] = sizes - (counts - 1) * WINDOW
    return flat.reshape(-1, WINDOW), first[:-1], fill


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS) -> ByteNet | None:
    """A network trained on about `sample_docs` documents with a language that are not held out; None if there are none.

    Every label value is learned, however many there are. Each gives about as many documents, LEAST_DOCS or more if it has
    them, chosen by a hash of the id; of each, up to SAMPLE_CHARS characters from a place chosen by another hash. So what
    reaches the driver is bounded by sample_docs and the number of labels, not by the corpus. Windows are trained whole and
    cut short, so short texts are known too. Rows without an id are drawn by their texts, and equal rows count once, so no
    id gives more than its own texts.
    """
    d = docs.select(F.col(id_col).alias("id"), row_key(docs, id_col, text_col).alias("key"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    d = d.where(F.col("lang").isNotNull() & ~held_out("id"))
    counts = materialize(d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    languages = sorted(r["lang"] for r in counts.select("lang").collect())
    if not languages:
        return None
    quota = max(LEAST_DOCS, sample_docs / len(languages))
    drawn = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 40))
    chosen = d.join(few(counts), "lang").where(drawn < F.lit(quota) / F.col("n") * (1 << 40))
    place = F.pmod(F.xxhash64("key", F.lit("place")), F.greatest(F.length("text") - SAMPLE_CHARS, F.lit(1))).cast("int")
    parts = chosen.where("text is not null").select("key", "lang", F.substring("text", place + 1, F.lit(SAMPLE_CHARS)).alias("text"))
    got = parts.distinct().select("lang", "text").collect()
    rng = np.random.default_rng(3)
    texts, labels = [], []
    for lang, text in sorted(map(tuple, got)):
        if _LETTER.search(text):
            data = text.encode()
            at = int(rng.integers(0, max(1, len(data) - 8)))
            texts += [data, data[at : at + int(rng.integers(8, 128))]]
            labels += [languages.index(lang)] * 2
    net = ByteNet.fresh(languages)
    if not texts:
        return net
    windows, first, _ = cut(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff([*first, len(windows)]))
    return net.fit(windows, np.array(labels)[owner])


def _judge(net: ByteNet | None, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text, a few MB at a time."""
    n = len(texts)
    langs, scores, held, size, rows = [UNKNOWN] * n, np.zeros(n), [], 0, []
    for i, text in enumerate(texts):
        text = text.as_py()
        if net is not None and text and _LETTER.search(text):
            held.append(text.encode())
            rows.append(i)
            size += len(held[-1])
        if held and (size >= _HELD or i + 1 == n):
            which, p = net.predict(held)
            for row, w, s in zip(rows, which.tolist(), p.tolist(), strict=True):
                langs[row], scores[row] = net.languages[w], s
            held, size, rows = [], 0, []
    return langs, scores


def identify(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score (0 to 1), from all bytes of the text and nothing else.

    `und` with score 0 where the text is null, empty or has no letter, or where nothing was learned. Rows stream through
    the network a few MB at a time, whatever the length of a text; nothing is shuffled. Repeated rows are predicted
    alike; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _judge(model.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores)], names=["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents, with all their columns, of which a language could be told; rejects those predicted `und`.

    Only texts pass through the network, and a flag comes back; rows are filtered where they are and nothing is shuffled.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))

    @F.arrow_udf("boolean")
    def known(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([x != UNKNOWN for x in _judge(model.value, texts)[0]], pa.bool_())

    return docs.where(known(text_or_empty(text_col)))
