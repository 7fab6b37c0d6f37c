"""Language identification by a byte convolutional network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from echoframe.llm.text import lean, mix, utf8

UNKNOWN = "und"

WINDOW = 256

#: Filter widths, filters of each width, and windows worked on at once (each takes about 40 KB).
WIDTHS, FILTERS, BATCH = (2, 3, 4), 8, 512

#: Training windows of each language; what the driver holds is bounded by it.
TRAINING_WINDOWS = 1500


def _letters() -> np.ndarray:
    table = np.full(256, 0x20, np.uint8)
    for lo, hi in ((0x61, 0x7B), (0x80, 0x100)):
        table[lo:hi] = np.arange(lo, hi)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    return table


LETTER = _letters()


def windows(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and text of the fixed-length windows that cover every text."""
    counts = -(-np.diff(at) // WINDOW)
    text = np.repeat(np.arange(len(counts)), counts)
    start = at[:-1][text] + (np.arange(len(text)) - (np.cumsum(counts) - counts)[text]) * WINDOW
    return start, np.minimum(start + WINDOW, at[1:][text]), text


def matrix(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Windows as rows of bytes, A-Z as a-z and all that is no letter as a space."""
    place = start[:, None] + np.arange(WINDOW)
    inside = place < end[:, None]
    place = np.minimum(place, max(len(data) - 1, 0))
    return np.where(inside, LETTER[data[place]], np.uint8(0x20))


@dataclass
class Network:
    """One-hot bytes, filters of several widths, maximum over the window, softmax."""

    languages: list[str]
    filters: list[np.ndarray]  # of each width: (width, 256, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> list[tuple[int, np.ndarray]]:
        """The filters as tables by pairs of bytes: half as many look-ups."""
        kept = []
        for f in self.filters:
            parts = [(j, (f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, -1)) for j in range(0, len(f) - 1, 2)]
            if len(f) % 2:
                parts.append((len(f) - 1, f[-1]))
            kept.append(parts)
        return kept

    def pooled(self, m: np.ndarray, tables) -> np.ndarray:
        pair = (m[:, :-1].astype(np.uint16) << 8) | m[:, 1:]
        best = []
        for f, parts in zip(self.filters, tables):
            n = WINDOW - len(f) + 1
            total = None
            for j, t in parts:
                got = t[(pair if len(t) > 256 else m)[:, j:j + n]]
                total = got if total is None else np.add(total, got, out=total)
            best.append(total.max(axis=1))
        return np.maximum(np.concatenate(best, axis=1) + self.bias, 0)

    def probabilities(self, m: np.ndarray, tables) -> np.ndarray:
        z = self.pooled(m, tables) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def train(m: np.ndarray, y: np.ndarray, languages: list[str], passes: int = 8, seed: int = 7) -> Network:
    """Fit by Adam on the cross-entropy; every pass sees the windows in another order."""
    rng = np.random.default_rng(seed)
    k = FILTERS * len(WIDTHS)
    p = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    p += [np.zeros(k, np.float32), rng.normal(0, 0.3, (k, len(languages))).astype(np.float32),
          np.zeros(len(languages), np.float32)]
    first, second, step = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    for _ in range(passes):
        order = rng.permutation(len(m))
        for lo in range(0, len(m), 64):
            x, t = m[order[lo:lo + 64]], y[order[lo:lo + 64]]
            rows, grads, best, spots = np.arange(len(x))[:, None], [np.zeros_like(a) for a in p], [], []
            for f in p[:len(WIDTHS)]:
                n = WINDOW - len(f) + 1
                total = sum(f[j][x[:, j:j + n]] for j in range(len(f)))
                spots.append(total.argmax(axis=1))
                best.append(np.take_along_axis(total, spots[-1][:, None, :], axis=1)[:, 0])
            raw = np.concatenate(best, axis=1) + p[-3]
            h = np.maximum(raw, 0)
            z = h @ p[-2] + p[-1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(t)), t] -= 1
            z /= len(t)
            grads[-1], grads[-2] = z.sum(axis=0), h.T @ z
            back = (z @ p[-2].T) * (raw > 0)
            grads[-3] = back.sum(axis=0)
            for i, spot in enumerate(spots):
                own = back[:, i * FILTERS:(i + 1) * FILTERS]
                for j in range(len(p[i])):
                    np.add.at(grads[i][j], (x[rows, spot + j], np.arange(FILTERS)[None, :]), own)
            step += 1
            for a, g, u, v in zip(p, grads, first, second):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                a -= 0.01 * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Network(languages, p[:len(WIDTHS)], p[-3], p[-2], p[-1])


def fit(df: DataFrame, key: str, text: str, label: str, usable: Column,
        per_language: int = TRAINING_WINDOWS) -> Network | None:
    """Train on about ``per_language`` windows of each language among ``usable`` rows with a label.

    Windows are drawn by a hash of the row's key and text and of the window's place, so the same rows give the same
    network, and one key for many rows draws like many keys.  Rows equal in key and text count once.  A language
    of which nothing is drawn so is drawn from again, without chance.  At most twice as many windows as asked for
    reach the driver.  None if no usable row has a label and a text.
    """
    own = F.col(f"`{text}`").cast("string")
    rows = df.where(usable & F.col(f"`{label}`").isNotNull()).select(
        F.xxhash64(F.col(f"`{key}`"), own).alias("key"), F.col(f"`{label}`").cast("string").alias("label"),
        own.alias("text"))
    made = F.ceil(F.octet_length("text") / WINDOW)
    # One row for each language.
    counts = rows.groupBy("label").agg(F.sum(made).alias("n")).where("n > 0").orderBy("label").collect()
    if not counts:
        return None
    def drawn_by(share: dict[str, float]) -> list:
        def draw(batches):
            for b in batches:
                data, at = utf8(b.column(2))
                start, end, text_no = windows(data, at)
                base = b.column(0).to_numpy().view(np.uint64)
                u = mix(base[text_no] + start.astype(np.uint64) - at[:-1][text_no].astype(np.uint64))
                part = np.array([share.get(x, 0.0) for x in b.column(1).to_pylist()])
                keep = np.flatnonzero(u.astype(np.float64) / 2.0**64 < part[text_no])
                m = matrix(data, start[keep], end[keep])
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).take(pa.array(text_no[keep])), pa.array(u[keep].astype(np.int64)),
                     pa.array([r.tobytes() for r in m], pa.binary())], names=["label", "u", "window"])

        got = rows.where(F.col("label").isin(*share)).mapInArrow(lean(draw), "label string, u long, window binary")
        return got.dropDuplicates(["label", "u"]).orderBy("u", "label", "window").limit(2 * per_language * len(share)).collect()

    drawn = drawn_by({r["label"]: min(1.0, per_language / r["n"]) for r in counts})
    missing = {r["label"] for r in counts} - {r["label"] for r in drawn}
    if missing:
        drawn += drawn_by(dict.fromkeys(missing, 1.0))
    drawn.sort(key=lambda r: (r["u"], r["label"], r["window"]))
    languages = [r["label"] for r in counts]
    number = {x: i for i, x in enumerate(languages)}
    if not drawn:
        return None
    m = np.frombuffer(b"".join(bytes(r["window"]) for r in drawn), np.uint8).reshape(-1, WINDOW)
    return train(m, np.array([number[r["label"]] for r in drawn]), languages)


def _reader(network: Network | None):
    """Function from a string column to its languages and scores."""
    def read(column):
        import regex

        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        data, at = utf8(column)
        n = len(at) - 1
        names, scores = np.full(n, UNKNOWN, object), np.zeros(n)
        if network is None or not n:
            return names, scores
        tables = network.tables()
        ascii_letters = np.zeros(n, np.int64)
        total = np.zeros((n, len(network.languages)))
        start, end, text = windows(data, at)
        for lo in range(0, len(start), BATCH):
            s, e, t = (x[lo:lo + BATCH] for x in (start, end, text))
            m = matrix(data, s, e)
            inside = m != 0x20
            np.add.at(ascii_letters, t, (inside & (m < 0x80)).sum(axis=1))
            weight = inside.sum(axis=1) + 1e-3
            np.add.at(total, t, network.probabilities(m, tables) * weight[:, None])
        some = ascii_letters > 0
        letter = regex.compile(r"\p{L}")
        for i in np.flatnonzero(~some):
            some[i] = bool(letter.search(column[int(i)].as_py() or ""))
        share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
        best = share.argmax(axis=1)
        names[some] = np.array(network.languages, object)[best[some]]
        scores[some] = np.clip(share[np.arange(n), best][some], 0, 1)
        return names, scores

    return read


def predict(df: DataFrame, key: str, text: str, network: Network | None) -> DataFrame:
    """``key``, ``lang_pred`` and ``score`` of every row, over its whole text.

    A text is cut into windows of 256 bytes; their probabilities are averaged, each by its number of
    letters.  Null texts and texts without a letter are ``und`` with score 0, and so is every text if
    there is no network.  Repeated rows get a row each.
    """
    read = _reader(network)

    def rows(batches):
        for b in batches:
            names, scores = read(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores)],
                                             names=["key", "lang_pred", "score"])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(lean(rows), schema)


def keep_known(df: DataFrame, text: str, network: Network | None, least: float = 0.4) -> DataFrame:
    """Rows of ``df`` whose text is in a known language with a score of at least ``least``."""
    read, place = _reader(network), df.columns.index(text)

    def rows(batches):
        for b in batches:
            names, scores = read(b.column(place))
            yield b.filter(pa.array((names != UNKNOWN) & (scores >= least)))

    return df.mapInArrow(lean(rows), df.schema)
