r"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads the UTF-8 bytes of the whole lower-cased text forwards and backwards, spaces and digits and all, and
labels every byte with a distribution over the languages; a document's probabilities pool those of all its bytes (sums of
logarithms decide, and the mean probability of the language that wins is the score). A text is read in windows of CORE bytes
with CONTEXT more on either side, from which the state comes: a byte is labelled in one window, and what it depends on is the
text within CONTEXT bytes of its window. Windows of like length are read side by side, so memory doesn't grow with a text.

The network is trained here in numpy by backpropagation through time, on stretches of TRAIN bytes drawn from anywhere in
the whole texts of a bounded sample of labelled rows: at most DOCS_A_LANGUAGE documents of each language, and about SAMPLE of
all, drawn by a hash of doc_id. Every language that a learnable row has is learned, however many there are.

Defined results: a null text and one without a letter get `und` with a score of 0, as do all if there is nothing to learn
from; ties go to the language that sorts first; repeated rows each get a result; an empty table gives an empty result.
A kept column called like one of predict()'s own gives way to it; both can be given other names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, by_batch

DOCS_A_LANGUAGE, SAMPLE = 400, 6000
HIDDEN, EMBED, BATCH, STEPS, RATE, TRAIN = 16, 16, 128, 500, 0.015, 48
CORE, CONTEXT = 192, 16
UNKNOWN = "und"
_PAD, _ROWS, _CELLS, _BYTES = 256, 1024, 1 << 17, 1 << 22


def encode(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as a matrix with PAD behind each run, and the mask of what isn't padding."""
    length = np.array([len(r) for r in runs])
    mask = np.arange(length.max())[None, :] < length[:, None]
    x = np.full(mask.shape, _PAD, np.int64)
    x[mask] = np.frombuffer(b"".join(runs), np.uint8)
    return x, mask


@dataclass
class Network:
    """A gated recurrent unit each way (gates z, r and the candidate side by side) and a softmax on both states.

    Inside, arrays have the bytes' spots first, then features or languages, then the runs.
    """

    languages: list[str]
    weights: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        weights = {"embed": draw(_PAD + 1, EMBED) * 4, "out": draw(2 * HIDDEN, len(languages)), "out_b": np.zeros(len(languages), np.float32)}
        for way in "fb":
            weights |= {f"{way}_x": draw(EMBED, 3 * HIDDEN), f"{way}_h": draw(HIDDEN, 3 * HIDDEN), f"{way}_b": np.zeros(3 * HIDDEN, np.float32)}
        return cls(languages, weights)

    def states(self, x: np.ndarray, mask: np.ndarray, tapes: dict[str, list] | None = None) -> np.ndarray:
        """Both states after each byte; a state passes padding unchanged."""
        w, n, at, on = self.weights, HIDDEN, np.ascontiguousarray(x.T), np.ascontiguousarray(mask.T)
        out, whole = np.empty((len(at), 2 * n, len(x)), w["embed"].dtype), on.all(axis=1)
        for k, way in enumerate("fb"):
            given = np.ascontiguousarray((w["embed"] @ w[f"{way}_x"] + w[f"{way}_b"]).T)
            gates, candidate = np.ascontiguousarray(w[f"{way}_h"][:, : 2 * n].T), np.ascontiguousarray(w[f"{way}_h"][:, 2 * n :].T)
            h = np.zeros((n, len(x)), out.dtype)
            for t in range(len(at)) if way == "f" else reversed(range(len(at))):
                g = given.take(at[t], axis=1, mode="clip")
                zr = gates @ h
                zr += g[: 2 * n]
                zr *= 0.5
                np.tanh(zr, out=zr)
                zr += 1
                zr *= 0.5
                c = candidate @ (zr[n:] * h)
                c += g[2 * n :]
                np.tanh(c, out=c)
                if tapes is not None:
                    tapes.setdefault(way, []).append((t, h, zr[:n], zr[n:], c))
                step = c - h
                step *= zr[:n]
                if not whole[t]:
                    step *= on[t]
                h = h + step
                out[t, k * n : (k + 1) * n] = h
        return out

    def log_posteriors(self, states: np.ndarray) -> np.ndarray:
        """For each byte, the logarithms of the languages' probabilities."""
        out = np.matmul(self.weights["out"].T, states)
        out += self.weights["out_b"][:, None]
        out -= out.max(axis=1, keepdims=True)
        out -= np.log(np.exp(out).sum(axis=1, keepdims=True))
        return out

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the bytes, and its gradients by backpropagation through time."""
        tapes: dict[str, list] = {}
        states = self.states(x, mask, tapes)
        logp = self.log_posteriors(states)
        total, w, n, on, runs = mask.sum(), self.weights, HIDDEN, mask.T, np.arange(len(y))
        loss = -float((logp[:, y, runs] * on).sum() / total)
        d = np.exp(logp)
        d[:, y, runs] -= 1
        d *= on[:, None, :] / np.float32(total)
        flat = lambda a: a.transpose(1, 0, 2).reshape(a.shape[1], -1)
        grads = {"out": flat(states) @ flat(d).T, "out_b": d.sum(axis=(0, 2)), "embed": np.zeros_like(w["embed"])}
        back = np.matmul(w["out"], d)
        order = np.argsort(x.T, axis=None, kind="stable")
        seen, first = np.unique(x.T.ravel()[order], return_index=True)
        for k, way in enumerate("fb"):
            recur, given = w[f"{way}_h"], np.zeros((len(states), 3 * n, len(x)), states.dtype)
            g_recur, dh = np.zeros_like(recur), np.zeros((n, len(x)), states.dtype)
            for t, h, z, r, c in reversed(tapes[way]):
                dh = dh + back[t, k * n : (k + 1) * n]
                at = dh * on[t]
                dc = at * z * (1 - c * c)
                drh = recur[:, 2 * n :] @ dc
                given[t, :n], given[t, n : 2 * n], given[t, 2 * n :] = at * (c - h) * z * (1 - z), drh * h * r * (1 - r), dc
                g_recur[:, : 2 * n] += h @ given[t, : 2 * n].T
                g_recur[:, 2 * n :] += (r * h) @ dc.T
                dh = dh - at * z + drh * r + recur[:, : 2 * n] @ given[t, : 2 * n]
            by_byte = np.zeros((_PAD + 1, 3 * n), states.dtype)
            by_byte[seen] = np.add.reduceat(flat(given).T[order], first, axis=0)
            grads[f"{way}_h"], grads[f"{way}_b"] = g_recur, by_byte.sum(axis=0)
            grads[f"{way}_x"] = w["embed"].T @ by_byte
            grads["embed"] += by_byte @ w[f"{way}_x"].T
        return loss, grads

    def train(self, texts: list[bytes], y: np.ndarray, steps: int = STEPS, seed: int = 11) -> Network:
        """Adam, with a rate that falls to nothing; each language has the same weight, and each of its texts."""
        rng, order = np.random.default_rng(seed), [np.flatnonzero(y == k) for k in range(len(self.languages))]
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(a) for k, a in self.weights.items()}
        for step in range(1, steps + 1):
            pick = np.array([order[k][int(u * len(order[k]))] for k, u in zip(rng.integers(0, len(order), BATCH), rng.random(BATCH))])
            starts = [int(u * (max(0, len(texts[i]) - TRAIN) + 1)) for i, u in zip(pick, rng.random(BATCH))]
            x, mask = encode([texts[i][s : s + TRAIN] for i, s in zip(pick, starts)])
            _, grads = self.gradients(x, mask, y[pick])
            rate = RATE * (1 - (step - 1) / steps)
            for k, g in grads.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.weights[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """For each text: the sums over its bytes of the log probabilities, of the probabilities, and of 1."""
        n = len(self.languages)
        out = np.zeros((len(texts), 2 * n + 1))
        length = np.array([len(t) for t in texts])
        windows = -(-length // CORE)
        doc = np.repeat(np.arange(len(texts)), windows)
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])[doc]
        end = begin + length[doc]
        core = begin + CORE * (np.arange(len(doc)) - np.repeat(np.cumsum(windows) - windows, windows))
        low, high, core_end = np.maximum(core - CONTEXT, begin), np.minimum(core + CORE + CONTEXT, end), np.minimum(core + CORE, end)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        order = np.argsort(high - low, kind="stable")
        for k in range(0, len(order), _ROWS):
            at = order[k : k + _ROWS]
            spot = low[at][:, None] + np.arange((high[at] - low[at]).max())
            mask = spot < high[at][:, None]
            states = self.states(np.where(mask, flat[np.minimum(spot, len(flat) - 1)], _PAD), mask)
            counted = np.ascontiguousarray(((spot >= core[at][:, None]) & (spot < core_end[at][:, None])).T, np.float32)
            sums = np.zeros((len(at), 2 * n + 1))
            sums[:, -1] = counted.sum(axis=0)
            per = max(1, _CELLS // (n * len(at)))
            for t in range(0, len(states), per):
                logp, some = self.log_posteriors(states[t : t + per]), counted[t : t + per]
                sums[:, :n] += np.einsum("tln,tn->nl", logp, some)
                sums[:, n : 2 * n] += np.einsum("tln,tn->nl", np.exp(logp, out=logp), some)
            np.add.at(out, doc[at], sums)
        return out


def bytes_of(text: str) -> bytes:
    return text.lower().encode("utf-8", "replace")


def _predicted(network: Network, text_at: int):
    n = len(network.languages)

    def answers(part: list[bytes]) -> tuple[list[str], list[float]]:
        """For texts without a letter, which come as empty bytes, UNKNOWN."""
        rows = network.pooled(part) if any(part) else np.zeros((len(part), 2 * n + 1))
        best = rows[:, :n].argmax(axis=1)
        score = rows[np.arange(len(part)), n + best] / np.maximum(rows[:, -1], 1)
        return [network.languages[b] if t else UNKNOWN for b, t in zip(best, part)], np.clip(score, 0, 1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            legible = batch.column(batch.num_columns - 1).to_pylist()
            found, score, part = [], [], []
            for text, ok in zip(batch.column(text_at), legible):
                part.append(bytes_of(text.as_py()) if ok else b"")
                if sum(map(len, part)) > _BYTES:
                    a, b = answers(part)
                    found, score, part = found + a, score + b, []
            a, b = answers(part) if part else ([], [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found + a, pa.string()), pa.array(score + b, pa.float64())], names=[*batch.schema.names[:-1], "found", "sure"])

    return run


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, learnable: Column, text_col: str, lang_col: str, id_col: str, docs_a_language: int = DOCS_A_LANGUAGE, steps: int = STEPS, sample: int = SAMPLE) -> Network | None:
    """A network for the languages of the rows where learnable holds; None if there are no such rows with letters."""
    legible = F.col(text_col).rlike(r"\p{L}")
    rows = docs.where(learnable & F.col(lang_col).isNotNull() & legible).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col), F.lit("draw")), F.lit(1 << 30)).alias("draw"))
    counts = bounded(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("draw").alias("least")), "languages")
    quota = max(1, min(docs_a_language, sample // max(1, counts.count())))
    # Each language has its least draw; limit() only makes the bound certain where ids repeat.
    drawn = rows.join(counts, "lang").where((F.col("draw") * F.col("n") < quota * float(1 << 30)) | (F.col("draw") == F.col("least")))
    found = sorted((r["lang"], bytes_of(r["text"])) for r in drawn.select("lang", "text").limit(2 * max(sample, counts.count())).collect())
    if not found:
        return None
    languages = sorted({lang for lang, _ in found})
    index = {lang: k for k, lang in enumerate(languages)}
    return Network.fresh(languages).train([t for _, t in found], np.array([index[lang] for lang, _ in found]), steps)


def predict(docs: DataFrame, network: Network | None, text_col: str = "text", keep: list[str] | None = None, lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """The columns keep (all, if None) with lang_name and score_name behind them."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (lang_name, score_name)]
    if network is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias(lang_name), F.lit(0.0).alias(score_name))
    # A text without a letter isn't read; the text goes over once, also where it is kept.
    passed = list(keep) if text_col in keep else [*keep, text_col]
    rows = docs.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(passed)), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("legible"))
    schema = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(passed))
    out = by_batch(rows, _predicted(network, passed.index(text_col)), f"{schema}, found string, sure double")
    return out.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(keep)), F.col("found").alias(lang_name), F.col("sure").alias(score_name))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """id_col, held_out, lang_pred, score for each row; learns from the rows that aren't held out."""
    network = fit(docs, ~held_out(id_col) & F.col(id_col).isNotNull(), text_col, lang_col, id_col, **options)
    out = predict(docs, network, text_col, [id_col])
    return out.select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
