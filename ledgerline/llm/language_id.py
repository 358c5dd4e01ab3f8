"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import discard, keyed, materialize, table

#: Documents, and spans of SPAN_TRAIN bytes, of each language that a model is trained on, at most.
SAMPLE_DOCS, SAMPLE_SPANS, SPAN_TRAIN = 400, 3_000, 64
#: Sizes of the network. The states run over spans of SPAN bytes that overlap: what lies within CONTEXT bytes of a span's end is only context for
#: the rest, unless the text begins or ends there. Shorter spans end in blanks, up to a multiple of STEP bytes; SPANS go through the network at once.
EMBED, HIDDEN, SPAN, CONTEXT, STEP, SPANS = 12, 8, 256, 16, 32, 1024

_SMALL = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes of letters: a to z and all beyond ASCII.
_LETTER = np.array([97 <= c <= 122 or c >= 128 for c in range(256)], dtype=np.float32)


def folded(text: str | None) -> bytes:
    """The bytes of a text, A-Z as small letters."""
    return text.encode().translate(_SMALL) if text else b""


def spans_of(n: int) -> list[int]:
    """Where the spans of a text of n bytes start."""
    return [0] if n <= SPAN else list(range(0, n - 2 * CONTEXT, SPAN - 2 * CONTEXT))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def padded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(words, positions) of byte values, padded with 0, and which positions are real."""
    length = np.array([len(w) for w in words])
    out = np.zeros((len(words), int(length.max())), dtype=np.uint8)
    mask = np.arange(out.shape[1])[None, :] < length[:, None]
    out[mask] = np.frombuffer(b"".join(words), dtype=np.uint8)
    return out, mask


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiGru:
    """Byte embedding, a gated recurrent unit each way, and a linear layer that labels every position."""

    def __init__(self, languages: list[str], seed: int = 0, hidden: int = HIDDEN, embed: int = EMBED):
        r = np.random.default_rng(seed)
        self.languages, h, e = languages, hidden, embed
        self.p = {"E": r.normal(0, 0.3, (256, e)), "O": r.normal(0, 0.3, (2 * h, len(languages))), "o": np.zeros(len(languages))}
        for d in "fb":
            self.p |= {f"W{d}": r.normal(0, 0.5 / np.sqrt(e), (e, 3 * h)), f"U{d}": r.normal(0, 0.5 / np.sqrt(h), (h, 3 * h)), f"c{d}": np.zeros(3 * h)}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States of one direction over (n, t, e); padding leaves a state as it is. keep: what going back needs."""
        n, t, _ = x.shape
        w, u, c = self.p[f"W{d}"], self.p[f"U{d}"], self.p[f"c{d}"]
        h = u.shape[0]
        pre = x @ w + c
        state, states, trail = np.zeros((n, h), dtype=x.dtype), np.zeros((n, t, h), dtype=x.dtype), {}
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            zr = _sigmoid(pre[:, i, : 2 * h] + state @ u[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            g = np.tanh(pre[:, i, 2 * h :] + (r * state) @ u[:, 2 * h :])
            new = np.where(mask[:, i, None], (1 - z) * state + z * g, state)
            if keep:
                trail[i] = (state, z, r, g)
            states[:, i] = state = new
        return states, trail

    def positions(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(words, positions, languages) of probabilities, and which positions are real."""
        b, mask = padded(words)
        x = self.p["E"][b]
        both = np.concatenate((self._run("f", x, mask, False)[0], self._run("b", x, mask, False)[0]), axis=2)
        y = both @ self.p["O"] + self.p["o"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        return y / y.sum(axis=2, keepdims=True), mask

    def loss(self, words: list[bytes], target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
        """Mean cross entropy over the positions, words weighted, and its gradients by going back through time. target: (words, languages) of shares."""
        b, mask = padded(words)
        x = self.p["E"][b]
        (fs, ft), (bs, bt) = self._run("f", x, mask, True), self._run("b", x, mask, True)
        both = np.concatenate((fs, bs), axis=2)
        y = both @ self.p["O"] + self.p["o"]
        y = np.exp(y - y.max(axis=2, keepdims=True))
        y /= y.sum(axis=2, keepdims=True)
        scale = (weight / weight.sum() / mask.sum(axis=1))[:, None, None] * mask[:, :, None]
        value = -float((scale * target[:, None, :] * np.log(y + 1e-12)).sum())
        dy = (y - target[:, None, :]) * scale
        flat = lambda a: a.reshape(-1, a.shape[-1])
        g = {"O": flat(both).T @ flat(dy), "o": dy.sum(axis=(0, 1))}
        d_both = dy @ self.p["O"].T
        h = fs.shape[2]
        dx = np.zeros_like(x)
        for d, trail, part in (("f", ft, d_both[:, :, :h]), ("b", bt, d_both[:, :, h:])):
            u, w = self.p[f"U{d}"], self.p[f"W{d}"]
            du, d_pre, carry = np.zeros_like(u), np.zeros((*x.shape[:2], 3 * h)), np.zeros((len(words), h))
            for i in range(x.shape[1] - 1, -1, -1) if d == "f" else range(x.shape[1]):
                state, z, r, cand = trail[i]
                up = carry + part[:, i]
                real = np.where(mask[:, i, None], up, 0)
                dg = real * z * (1 - cand**2)
                d_rs = dg @ u[:, 2 * h :].T
                dz = real * (cand - state) * z * (1 - z)
                dr = d_rs * state * r * (1 - r)
                dzr = np.concatenate((dz, dr), axis=1)
                du[:, : 2 * h] += state.T @ dzr
                du[:, 2 * h :] += (r * state).T @ dg
                d_pre[:, i] = np.concatenate((dzr, dg), axis=1)
                carry = np.where(mask[:, i, None], real * (1 - z) + d_rs * r + dzr @ u[:, : 2 * h].T, up)
            g |= {f"U{d}": du, f"W{d}": flat(x).T @ flat(d_pre), f"c{d}": d_pre.sum(axis=(0, 1))}
            dx += d_pre @ w.T
        g["E"] = np.zeros_like(self.p["E"])
        by = np.argsort(b[mask], kind="stable")
        seen, start = np.unique(b[mask][by], return_index=True)
        g["E"][seen] = np.add.reduceat(dx[mask][by], start, axis=0)
        return value, g

    def train(self, words: list[bytes], target: np.ndarray, weight: np.ndarray, steps: int = 400, batch: int = 256, rate: float = 0.01, seed: int = 0) -> None:
        """Adam over batches that are drawn by weight."""
        r, share = np.random.default_rng(seed), weight / weight.sum()
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            pick = r.choice(len(words), size=min(batch, len(words)), p=share)
            _, g = self.loss([words[i] for i in pick], target[pick], np.ones(len(pick)))
            for k, x in self.p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                x -= rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def lighter(self) -> BiGru:
        """The network in single precision, with what each byte adds to the gates in a table."""
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}
        self.table = {d: self.p["E"] @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}
        return self

    def label(self, x: np.ndarray) -> np.ndarray:
        """(positions, spans, languages) of probabilities for bytes x (positions, spans): every position of every span, by both directions."""
        h = self.p["Uf"].shape[0]
        y = np.empty((*x.shape, len(self.languages)), np.float32)
        for d, order, out in (("f", range(len(x)), self.p["O"][:h]), ("b", range(len(x) - 1, -1, -1), self.p["O"][h:])):
            table, gates, cand = self.table[d], np.ascontiguousarray(self.p[f"U{d}"][:, : 2 * h]), np.ascontiguousarray(self.p[f"U{d}"][:, 2 * h :])
            state = np.zeros((x.shape[1], h), np.float32)
            for i in order:
                pre = table.take(x[i], axis=0)
                zr = state @ gates
                zr += pre[:, : 2 * h]
                np.negative(zr, zr)
                np.exp(zr, zr)
                zr += 1
                np.reciprocal(zr, zr)
                g = (zr[:, h:] * state) @ cand
                g += pre[:, 2 * h :]
                np.tanh(g, g)
                g -= state
                g *= zr[:, :h]
                state = state + g
                if d == "f":
                    np.matmul(state, out, out=y[i])
                else:
                    y[i] += state @ out
        y += self.p["o"]
        np.exp(y, y)
        y /= y.sum(axis=2, keepdims=True)
        return y


def pooled(model: BiGru, texts: list[bytes]) -> np.ndarray:
    """(texts, languages): the mean of the labels of all positions of letters, each counted in one span; zeros for a text without any."""
    sums = np.zeros((len(texts), len(model.languages) + 1))
    flat = np.frombuffer(b"".join(t + b" " * SPAN for t in texts), dtype=np.uint8)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    offset = np.cumsum(size + SPAN) - size - SPAN
    each = [spans_of(len(t)) if t else [] for t in texts]
    doc, start = np.repeat(np.arange(len(texts)), [len(e) for e in each]), np.array([i for e in each for i in e], dtype=np.int64)
    length = np.minimum(SPAN, size[doc] - start)
    wide = -(-length // STEP) * STEP
    for width in np.unique(wide):
        chosen = np.flatnonzero(wide == width)
        place = np.arange(width)[:, None]
        for at in range(0, len(chosen), SPANS):
            c = chosen[at : at + SPANS]
            x = flat[offset[doc[c]] + start[c] + place]
            low = np.where(start[c] > 0, CONTEXT, 0)
            high = np.where(start[c] + SPAN < size[doc[c]], SPAN - CONTEXT, length[c])
            counts = _LETTER[x] * ((place >= low) & (place < high))
            y = model.label(x)
            part = np.concatenate((np.einsum("tnl,tn->nl", y, counts), counts.sum(axis=0)[:, None]), axis=1)
            np.add.at(sums, doc[c], part)
    return sums[:, :-1] / np.maximum(sums[:, -1:], 1)


def _train_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to rows (lang, span) of SPAN_TRAIN bytes with a letter, cut through the whole text."""
    for batch in batches:
        rows = [(name, raw[i : i + SPAN_TRAIN]) for name, raw in zip(batch.column("lang").to_pylist(), map(folded, batch.column("text").to_pylist()), strict=True) for i in range(0, len(raw), SPAN_TRAIN)]
        rows = [(name, part) for name, part in rows if _LETTER[np.frombuffer(part, dtype=np.uint8)].any()]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.binary())], names=["lang", "span"])


def _first(df: DataFrame, by: str, n: int, *order: str) -> DataFrame:
    """The n rows of each group with the least hash of `order`: of a large group only rows with a low hash, some 4 * n, are shuffled and ranked."""
    sizes = {r[by]: r["n"] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return df
    h = F.xxhash64(*order)
    share = F.element_at(F.create_map(*[F.lit(x) for k, m in sizes.items() for x in (k, min(1.0, (4 * n + 40) / m))]), F.col(by))
    low = df.where(h / F.lit(2.0**64) + 0.5 <= share)
    return low.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(h, *order))).where(F.col("_rank") <= n).drop("_rank")


def train_language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE_DOCS, spans: int = SAMPLE_SPANS, seed: int = 0) -> BiGru | None:
    """A model of the languages in docs, or None if no row has a language and a letter.

    Trained on `spans` spans of bytes of each language, out of the `sample` rows of it with the least key hash; these bounds are parameters. Every
    position of a span bears the document's language. Numpy goes back through time over whole spans, word borders, digits and signs included.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    picked = materialize(_first(known.select(F.col(lang).alias("lang"), F.col(key).alias("key")), "lang", sample, "key").distinct(), "picked")
    rows = known.select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")).join(F.broadcast(picked), ["key", "lang"], "left_semi")
    cut = materialize(rows.select("lang", "text").mapInArrow(_train_spans, "lang string, span binary"), "spans")
    got = _first(cut.distinct(), "lang", spans, "span").orderBy("lang", "span").toArrow()
    discard(cut, picked)
    if not got.num_rows:
        return None
    label, held = got["lang"].to_pylist(), got["span"].to_pylist()
    names = sorted(set(label))
    target = np.eye(len(names))[[names.index(n) for n in label]]
    weight = 1 / target.sum(axis=0)[target.argmax(axis=1)]
    model = BiGru(names, seed)
    model.train(held, target, weight, steps=200, batch=128, rate=0.02, seed=seed)
    return model.lighter()


def identify_language(docs: DataFrame, model: BiGru | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of docs: key, lang_pred, score (0 to 1).

    The network labels every byte of the whole text, its states running over overlapping spans that cross the borders of words; the document's
    probabilities are the means over all positions of letters, lang_pred the largest (the first of equals) and score its probability. A span's
    labels depend on its own bytes only, so a text has one result wherever it is read. Null texts and texts without a letter, and all without a model, are
    `und` with a score of 0. Rows are independent: no shuffle; repeated rows each get their language; an empty input gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1).to_pylist()
                raw = [folded(t) if model and has_letter(t) else b"" for t in texts]
                p = pooled(model, raw) if model and any(raw) else np.zeros((len(raw), 1))
                best = p.argmax(axis=1)
                names = [model.languages[k] if r else "und" for k, r in zip(best.tolist(), raw, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(np.minimum(p[np.arange(len(raw)), best], 1.0), pa.float64())], names=[key, "lang_pred", "score"])

    return docs.select(key, text).mapInArrow(run, keyed(docs, key, "lang_pred string, score double"))


def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train_language_id(docs.where(~F.coalesce(held_out, F.lit(False))))
    return identify_language(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
