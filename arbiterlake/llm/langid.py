"""Language identification by a byte convolutional network trained in numpy.

Windows of fixed length slide over the whole text (lower-cased, ASCII other than letters as blanks). Filters
of several widths run over the bytes; the rectified maximum of each filter over the window feeds a softmax
over the languages. A document's prediction is the mean log probability of its windows.

A filter over one-hot bytes is a sum of table rows, and two neighbouring bytes share one row of a table of
pairs, so inference is a few gathers a byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow

WIDTHS = (2, 3, 4)
LETTER = regex.compile(r"\p{L}")
#: ASCII other than letters becomes a blank, capitals small letters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 97 <= b <= 122 else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(FOLD).split()) if text else b""


def windows(raw: bytes, width: int) -> np.ndarray:
    """Consecutive windows that cover all of ``raw``; the last one ends with it, a short text is padded with blanks."""
    if len(raw) <= width:
        return np.frombuffer(raw.ljust(width), np.uint8)[None, :]
    whole = len(raw) // width * width
    made = np.frombuffer(raw[:whole], np.uint8).reshape(-1, width)
    return made if whole == len(raw) else np.concatenate([made, np.frombuffer(raw[-width:], np.uint8)[None, :]])


@dataclass
class Network:
    """``filters[width]`` has shape (width, 256, filters); ``head`` maps pooled features to languages."""

    languages: list[str]
    window: int
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    head: np.ndarray
    offset: np.ndarray

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Rectified maxima of all filters and where they are."""
        out, where = [], []
        for w, table in self.filters.items():
            n = x.shape[1] - w + 1
            act = sum(table[k][x[:, k : k + n]] for k in range(w))
            at = act.argmax(axis=1)
            out.append(np.maximum(np.take_along_axis(act, at[:, None, :], axis=1)[:, 0] + self.bias[w], 0))
            where.append(at)
        return np.concatenate(out, axis=1), where

    def tables(self) -> list[tuple]:
        """Per width the tables to gather from: (offset, over pairs or bytes, rows)."""
        made = []
        for w, t in self.filters.items():
            steps = []
            for k in range(0, w - 1, 2):
                steps.append((k, True, (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1)))
            if w % 2:
                steps.append((w - 1, False, t[w - 1]))
            made.append((w, steps))
        return made

    def log_probabilities(self, x: np.ndarray, tables: list[tuple]) -> np.ndarray:
        pairs = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        out = []
        for w, steps in tables:
            n, act = x.shape[1] - w + 1, None
            for k, paired, rows in steps:
                part = rows[(pairs if paired else x)[:, k : k + n]]
                act = part if act is None else np.add(act, part, out=act)
            out.append(np.maximum(act.max(axis=1) + self.bias[w], 0))
        z = np.concatenate(out, axis=1) @ self.head + self.offset
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean cross-entropy by filters, biases, head and offset; that of a maximum goes to the place of the maximum."""
    h, where = net.pooled(x)
    z = h @ net.head + net.offset
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = (p @ net.head.T) * (h > 0)
    tables, biases, n = [], [], net.head.shape[0] // len(net.filters)
    for i, ((w, filters), at) in enumerate(zip(net.filters.items(), where)):
        g, table = back[:, i * n : (i + 1) * n], np.zeros_like(filters)
        for k in range(w):
            byte = np.take_along_axis(x, at + k, axis=1)
            np.add.at(table[k], (byte, np.arange(n)[None, :]), g)
        tables.append(table)
        biases.append(g.sum(axis=0))
    return [*tables, *biases, h.T @ p, p.sum(axis=0)]


def train(samples: np.ndarray, labels: np.ndarray, languages: list[str], filters: int = 8, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the mean cross-entropy of random batches."""
    rng = np.random.default_rng(seed)
    width = samples.shape[1] if samples.size else 192
    net = Network(
        languages, width,
        {w: rng.normal(0, 0.3 / np.sqrt(w), (w, 256, filters)).astype(np.float32) for w in WIDTHS},
        {w: np.zeros(filters, np.float32) for w in WIDTHS},
        rng.normal(0, 0.3, (filters * len(WIDTHS), len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    params = [*net.filters.values(), *net.bias.values(), net.head, net.offset]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(samples))
        for a in range(0, len(order), batch):
            own = order[a : a + batch]
            x, y = samples[own], labels[own]
            grads = gradients(net, x, y)
            step += 1
            for j, g in enumerate(grads):
                first[j] += 0.1 * (g - first[j])
                second[j] += 0.001 * (g * g - second[j])
                params[j] -= rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    return net


def chosen_rows(df: DataFrame, label_col: str, text_col: str, id_col: str, per_label: int) -> DataFrame:
    """``label``, ``text`` of at most ``per_label`` distinct labelled rows of each label: those with the smallest hash of id, label and text.

    Sketches count the distinct rows of each label (one row a label reaches the driver, as many as the network
    has outputs); a threshold on the hash then lets about twice as many through as are wanted, so that what
    meets to be ranked is small however common a label is. Rows that agree in all three count once.
    """
    labelled = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = labelled.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("string"), label_col, text_col).alias("_key"))
    counts = rows.groupBy("label").agg(F.approx_count_distinct("_key", 0.02).alias("n")).collect()
    limits = {r["label"]: -(2**63) + min(2**64 - 1, int(2**64 * (2 * per_label + 20) / max(r["n"], 1))) for r in counts}
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)), F.col("label")) if limits else F.lit(0)  # no join: no text moves that is not chosen
    few = rows.filter(F.col("_key") <= limit).groupBy("label", "_key").agg(F.any_value("text").alias("text"))
    first = Window.partitionBy("label").orderBy("_key")
    return few.withColumn("_no", F.row_number().over(first)).filter(F.col("_no") <= per_label).select("label", "text")


def fit(df: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_label: int = 500, window: int = 192) -> Network:
    """Train on all windows of the whole texts of at most ``per_label`` labelled rows of each language (``chosen_rows``).

    Rows without label or letters teach nothing; repeated rows count once; null ids are ids like others;
    other columns are not read; an empty table gives a network without languages.
    """

    def cut(batch):
        labels, cuts = [], []
        for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
            if LETTER.search(text):
                made = windows(folded(text), window)
                labels.extend([label] * len(made))
                cuts.extend(x.tobytes() for x in made)
        return {"label": labels, "cut": cuts}

    rows = chosen_rows(df.select(id_col, label_col, text_col), label_col, text_col, id_col, per_label)
    table = map_arrow(rows, cut, "label string, cut binary").toArrow().to_pydict()
    pairs = sorted(zip(table["label"], table["cut"]))  # the same order whatever the partitions
    languages = sorted({r[0] for r in pairs})
    samples = np.array([np.frombuffer(r[1], np.uint8) for r in pairs], dtype=np.uint8).reshape(len(pairs), window)
    return train(samples, np.array([languages.index(r[0]) for r in pairs], dtype=int), languages)


def identify(df: DataFrame, net: Network, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` with ``lang_pred`` and ``score`` (mean window probability, normalised) for every row.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned.
    Very long texts are read whole; nulls in kept columns pass through; rows correspond one to one; kept columns
    named like an output come back with ``_in`` added to their names; an empty table gives an empty result.
    """
    df = df.select(*(F.col(f"`{c}`").alias(f"{c}_in" if c in ("lang_pred", "score") else c) for c in keep), F.col(f"`{text_col}`").alias("_text"))
    keep, text_col = tuple(c for c in df.columns if c != "_text"), "_text"
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batch):
        tables = net.tables()
        label, score = [], []
        texts = batch.column(text_col).to_pylist()
        for a in range(0, len(texts), 64):
            part = texts[a : a + 64]
            readable = [i for i, t in enumerate(part) if net.languages and t and LETTER.search(t)]
            cuts = [windows(folded(part[i]), net.window) for i in readable]
            got: list = [("und", 0.0)] * len(part)
            if cuts:
                x = np.concatenate(cuts)
                logs = np.concatenate([net.log_probabilities(x[b : b + 256], tables) for b in range(0, len(x), 256)])
                mean = np.add.reduceat(logs, np.cumsum([0] + [len(c) for c in cuts])[:-1]) / np.array([[len(c)] for c in cuts])
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for i, row in zip(readable, p):
                    got[i] = net.languages[int(row.argmax())], float(row.max())
            label.extend(g[0] for g in got)
            score.extend(g[1] for g in got)
        return {**{c: batch.column(c) for c in keep}, "lang_pred": label, "score": score}

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "lang_pred string", "score double"])
    return map_arrow(df, run, schema)
