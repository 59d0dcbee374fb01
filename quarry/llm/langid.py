"""Language ID by a bidirectional gated recurrent network over bytes.

Two GRUs read a text's UTF-8 bytes, one forward and one backward. At each position a softmax over both states labels the
byte; a document's probabilities are the mean of its positions'. Training is backpropagation through time in numpy on
the driver, on a bounded sample of labelled rows, PIECES pieces of each, which lie anywhere in its whole text; scoring reads every byte of every text,
in windows of WINDOW bytes that numpy steps through side by side.

Arrays are laid out (features, batch). A step of a GRU: r, z = sigmoid(E[x] + U h), n = tanh(E[x] + r * U h), h = n + z (h - n);
E holds a column of input weights and bias for each byte.

Defined results: null text or text without a letter gets `und` and score 0, as does any text where no labelled row
could be learned from; a tie takes the language first in order; repeated rows get equal results; an empty table gives
an empty result; other columns are not read. For keep_identified the model also learns texts of no language, made at random (UNKNOWN),
and a document stays if its best label is a language with a probability clearly above the least that the best of so many can have.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import held_out, process_cache

WINDOW = 128
BATCH = 1024
UNKNOWN = "und"
#: The bound of the training sample is rows times windows: documents of each language that are learned from, at most about so many; windows (pieces) of each, drawn evenly over its whole
#: text; characters of a window. Labels beyond the LANGUAGES most frequent ones aren't learned.
SAMPLE_PER_LANGUAGE = 600
LANGUAGES = 1000
PIECES = 8
PIECE = 64
HIDDEN = 12


@dataclass
class Model:
    """Languages in order; per direction input weights E (3H, 256) and U (3H, H); output weights W (languages, 2H) and bias."""

    languages: list[str]
    weights: dict[str, np.ndarray]


def new_model(languages: list[str], hidden: int, seed: int = 0) -> Model:
    rng, h, k = np.random.default_rng(seed), hidden, len(languages)
    weights = {f"{kind}{way}": (rng.normal(size=shape) * scale).astype("f4") for way in "fb" for kind, shape, scale in (("E", (3 * h, 256), 0.5), ("U", (3 * h, h), h**-0.5))}
    return Model(languages, weights | {"W": (rng.normal(size=(k, 2 * h)) * 0.3).astype("f4"), "c": np.zeros((k, 1), "f4")})


def states(E: np.ndarray, U: np.ndarray, x: np.ndarray, kept: dict | None = None) -> np.ndarray:
    """The states (time, H, batch) of one GRU over x (time, batch); kept gets what backward() needs."""
    steps, batch = x.shape
    h2, size = 2 * U.shape[1], U.shape[1]
    out = np.empty((steps, size, batch), U.dtype)
    h, g, u, n = np.zeros((size, batch), U.dtype), np.empty((3 * size, batch), U.dtype), np.empty((3 * size, batch), U.dtype), np.empty((size, batch), U.dtype)
    for t in range(steps):
        np.take(E, x[t], axis=1, out=g, mode="clip")
        np.matmul(U, h, out=u)
        gates = g[:h2]
        gates += u[:h2]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        np.multiply(gates[:size], u[h2:], out=n)
        n += g[h2:]
        np.tanh(n, out=n)
        now = out[t]
        np.subtract(h, n, out=now)
        now *= gates[size:]
        now += n
        if kept is not None:
            kept[t] = (gates[:size].copy(), gates[size:].copy(), n.copy(), u[h2:].copy(), h)
        h = now
    return out


def backward(E: np.ndarray, U: np.ndarray, x: np.ndarray, kept: dict, d_out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of E and U, given those of the states: backpropagation through time."""
    dE, dU, dh = np.zeros_like(E), np.zeros_like(U), np.zeros_like(d_out[0])
    into = np.empty((E.shape[0], *x.shape), U.dtype)  # gradients of the input weights that each byte took
    for t in reversed(range(len(x))):
        r, z, n, u, h = kept[t]
        dh = dh + d_out[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * u * r * (1 - r)
        through = np.concatenate([dr, dz, dn * r])
        dU += through @ h.T
        np.concatenate([dr, dz, dn], out=into[:, t])
        dh = dh * z + U.T @ through
    order = np.argsort(x, axis=None, kind="stable")
    met, first = np.unique(x.ravel()[order], return_index=True)
    dE[:, met] = np.add.reduceat(into.reshape(len(E), -1)[:, order], first, axis=1)
    return dE, dU


def gradients(model: Model, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over all positions of x (time, batch) with labels y (batch), and its gradients."""
    w, kept_f, kept_b = model.weights, {}, {}
    hf = states(w["Ef"], w["Uf"], x, kept_f)
    hb = states(w["Eb"], w["Ub"], x[::-1], kept_b)[::-1]
    size, (steps, batch) = hf.shape[1], x.shape
    both = np.concatenate([hf, hb], axis=1)
    p = np.matmul(w["W"], both) + w["c"]
    p = np.exp(p - p.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    loss = -float(np.log(p[:, y, np.arange(batch)] + 1e-9).mean())
    p[:, y, np.arange(batch)] -= 1
    p /= steps * batch
    grads = {"W": np.einsum("tkb,thb->kh", p, both, optimize=True), "c": p.sum((0, 2))[:, None]}
    d = np.matmul(w["W"].T, p)
    grads["Ef"], grads["Uf"] = backward(w["Ef"], w["Uf"], x, kept_f, d[:, :size])
    grads["Eb"], grads["Ub"] = backward(w["Eb"], w["Ub"], x[::-1], kept_b, d[::-1, size:])
    return loss, grads


def train(texts: list[bytes], labels: list[str], hidden: int = HIDDEN, epochs: int = 2, window: int = 64, seed: int = 0) -> Model:
    """Adam over windows of the texts."""
    languages = sorted(set(labels))
    model, rng = new_model(languages, hidden, seed), np.random.default_rng(seed)
    cuts = [(np.frombuffer(t[i : i + window].ljust(window), np.uint8), languages.index(y)) for t, y in zip(texts, labels, strict=True) for i in range(0, max(1, len(t) - window // 2), window)]
    if not cuts or len(languages) < 2:
        return model
    x, y = np.stack([c[0] for c in cuts]).astype(np.intp), np.array([c[1] for c in cuts])
    mean = {k: np.zeros_like(v) for k, v in model.weights.items()}
    square = {k: np.zeros_like(v) for k, v in model.weights.items()}
    size, step = 256, 0
    epochs = max(epochs, -(-120 * size // len(cuts)))  # a small sample is read more often
    total = epochs * -(-len(cuts) // size)
    for _ in range(epochs):
        order = rng.permutation(len(cuts))
        for at in range(0, len(order), size):
            own, step = order[at : at + size], step + 1
            _, grads = gradients(model, np.ascontiguousarray(x[own].T), y[own])
            norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                model.weights[k] -= (0.02 * (1 - 0.9 * step / total) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype("f4")
    return model


def position_probabilities(model: Model, x: np.ndarray) -> np.ndarray:
    """(time, languages, batch) for bytes x (time, batch): the label of every position."""
    w = model.weights
    p = np.matmul(w["W"][:, : w["Uf"].shape[1]], states(w["Ef"], w["Uf"], x))
    p += np.matmul(w["W"][:, w["Uf"].shape[1] :], states(w["Eb"], w["Ub"], x[::-1]))[::-1]
    p += w["c"]
    np.exp(p, out=p)
    p /= p.sum(1, keepdims=True)
    return p


def document_probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(documents, languages): the mean over each document's positions (0 where it has none)."""
    lengths = np.diff(offsets)
    windows = -(-lengths // WINDOW)
    doc = np.repeat(np.arange(len(lengths)), windows)
    first = np.repeat(offsets[:-1], windows) + (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
    ends, step = offsets[1:][doc], np.arange(WINDOW)[:, None]
    sums = np.zeros((len(lengths), len(model.languages)))
    for at in range(0, len(doc), BATCH):
        own = slice(at, at + BATCH)
        place = first[own] + step
        inside = place < ends[own]
        p = position_probabilities(model, data[np.minimum(place, ends[own] - 1)].astype(np.intp))
        p *= inside[:, None, :]
        total = p.sum(0, dtype=np.float64)
        for k in range(len(total)):
            sums[:, k] += np.bincount(doc[own], total[k], len(lengths))
    return sums / np.maximum(lengths, 1)[:, None]


#: Blocks of letters that texts of no learned language are made of: Latin, accented, Greek, Cyrillic, Hebrew, Arabic, Devanagari, Thai, kana, Chinese, Hangul.
SCRIPTS = [(0x61, 0x7B), (0x41, 0x5B), (0xC0, 0x180), (0x391, 0x3CA), (0x410, 0x450), (0x5D0, 0x5EB), (0x621, 0x64B), (0x905, 0x93A), (0xE01, 0xE2F), (0x3041, 0x30FF), (0x4E00, 0x9FA5), (0xAC00, 0xD7A4)]
CODES = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ-_", "bcdfghjklmnpqrstvwxz"]


def unclear_texts(count: int, seed: int = 0) -> list[bytes]:
    """Texts of no language: encoded blobs, and words of letters drawn at random from a script."""
    rng, texts = np.random.default_rng(seed), []
    for i in range(count):
        low, high = SCRIPTS[0] if i % 4 == 1 else SCRIPTS[rng.integers(len(SCRIPTS))]
        letters = list(CODES[rng.integers(len(CODES))]) if i % 4 == 0 else [chr(x) for x in range(low, high)]
        drawn = rng.choice(letters, size := PIECES * PIECE).tolist()
        if i % 8:  # words; the rest are blobs without a space
            step = rng.integers(3, 12)
            for at in np.cumsum(rng.integers(2, step + 2, size)):
                if at < size:
                    drawn[at] = " "
        texts.append("".join(drawn).encode()[:size])
    return texts


def learned(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, hidden: int = HIDDEN, epochs: int = 2, unclear: bool = False, pieces: int = PIECES) -> Model:
    """A model of a bounded sample: about per_language rows of each language, by a hash of doc_id, and at most `pieces` windows of each; unclear adds texts of no language, labelled UNKNOWN.

    Held-out rows count for nothing, not even in the sample's shares."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id").cast("long"))).groupBy(F.col("lang").cast("string").alias("lang")).count()
    counted = labelled.orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counted:
        return Model([], {})
    share = F.create_map(*[F.lit(v) for r in counted for v in (r["lang"], min(1.0, per_language / r["count"]))])
    mixed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    sample = rows.where(mixed < share[F.col("lang")] * (1 << 20))
    # the text is cut into as many equal stretches as it has pieces, and each stretch gives one from a place drawn by a hash
    n = F.least(F.lit(pieces), F.ceil(F.length("text") / PIECE)).cast("int")
    drawn = lambda k: F.pmod(F.xxhash64("doc_id", k), F.lit(1 << 20)) / (1 << 20)
    start = lambda k: ((k + drawn(k)) * F.greatest(F.lit(0), F.length("text") - PIECE) / n).cast("int") + 1
    drawn_pieces = sample.select("doc_id", "lang", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.col("text").substr(start(k), F.lit(PIECE)))).alias("k", "piece"))
    got = sorted((r.lang, r.doc_id is None, r.doc_id or 0, r.k, r.piece) for r in drawn_pieces.collect())
    if not got:
        return Model([], {})
    most = max(Counter(r[0] for r in got).values())
    none = unclear_texts(-(-most // pieces)) if unclear else []
    return train([r[4].encode() for r in got] + none, [r[0] for r in got] + [UNKNOWN] * len(none), hidden, epochs)


def _scored(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_cache()
        for batch in batches:
            raw = batch.column(2).cast(pa.large_binary())
            n, offsets = len(raw), np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(1, np.uint8)
            lettered = np.asarray(batch.column(1))
            if model.languages and n:
                p = document_probabilities(model, data, offsets.astype(np.int64))
                best, top = p.argmax(1), p.max(1)
                names = np.where(lettered, np.array(model.languages, object)[best], UNKNOWN)
                top = np.where(lettered, np.minimum(top, 1.0), 0.0)
            else:
                names, top = np.full(n, UNKNOWN, object), np.zeros(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names.tolist(), pa.string()), pa.array(top, pa.float64()), *batch.columns[3:]], ["doc_id", "lang_pred", "score", *batch.schema.names[3:]])

    return score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.rlike(r"\p{L}").alias("lettered"), text.cast("binary").alias("raw"))
    return rows.mapInArrow(_scored(model), "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, hidden: int = HIDDEN) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    out = predict(docs, learned(docs, per_language, hidden))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _identified(model: Model, place: int, least: float):
    def identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        score = _scored(model)
        for batch in batches:
            text = batch.column(place).fill_null("")
            lettered = pc.match_substring_regex(text, r"\p{L}")
            numbers = pa.array(np.arange(batch.num_rows))
            rows = pa.RecordBatch.from_arrays([numbers, lettered, text.cast(pa.binary())], ["doc_id", "lettered", "raw"])
            for scored in score(iter([rows])):
                known = np.asarray(scored.column(1)) != UNKNOWN
                yield batch.filter(pa.array(known & (np.asarray(scored.column(2)) >= least)))

    return identified


#: A document whose best label is UNKNOWN, or has a probability less than this part of the way from 1 / labels, the least there can be, to 1, is of no clear language.
MARGIN = 0.25


def keep_identified(docs: DataFrame, model: Model, margin: float = MARGIN) -> DataFrame:
    """The rows of docs, all columns, whose language is known; all rows with a letter where nothing could be learned."""
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    least = margin + (1 - margin) / len(model.languages)
    return docs.mapInArrow(_identified(model, docs.columns.index("text"), least), docs.schema)
