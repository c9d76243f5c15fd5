"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Each direction is a gated recurrent layer whose input weights are one row per byte value.  A document's bytes are cut
into stretches of nearly equal length (at most ``span`` bytes; every byte is in one).  Within a stretch both directions
label every position with probabilities of the languages; a document's probabilities are the mean over all its bytes.
Training is backpropagation through time over stretches drawn from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

UNDETERMINED = "und"
HAS_LETTER = r"\p{L}"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    np.multiply(x, 0.5, out=x)
    x += 0.5
    return x


class ByteTagger:
    """Parameters by name: per direction d in f, b: E (256, 3H), U (H, 3H), c (H,), V (H, K); and the output bias o (K,)."""

    def __init__(self, langs: list[str], hidden: int = 16, span: int = 96, seed: int = 7):
        self.langs, self.hidden, self.span = langs, hidden, span
        rng, k = np.random.default_rng(seed), len(langs)
        draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
        self.p = {"o": np.zeros(k, np.float32)}
        for d in "fb":
            self.p |= {f"E{d}": draw(256, 3 * hidden), f"U{d}": draw(hidden, 3 * hidden), f"c{d}": np.zeros(hidden, np.float32), f"V{d}": draw(hidden, k)}

    def _step(self, d: str, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """(new h, update gate, reset gate, candidate, recurrent part of the candidate) for bytes x and states h."""
        n, p = self.hidden, self.p
        e, u = p[f"E{d}"].take(x, axis=0), h @ p[f"U{d}"]
        gates = _sigmoid(e[:, : 2 * n] + u[:, : 2 * n])
        inner = u[:, 2 * n :] + p[f"c{d}"]
        cand = np.tanh(e[:, 2 * n :] + gates[:, n:] * inner)
        z = gates[:, :n]
        return cand + z * (h - cand), z, gates[:, n:], cand, inner

    # -- training ------------------------------------------------------------------------------------------------

    def _grads(self, x: np.ndarray, lengths: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions and its gradients; x (B, T) bytes padded after ``lengths``."""
        b, t_max = x.shape
        mask = np.arange(t_max)[None, :] < lengths[:, None]
        back = np.where(mask, lengths[:, None] - 1 - np.arange(t_max)[None, :], np.arange(t_max)[None, :])
        inputs = {"f": x, "b": np.take_along_axis(x, back, axis=1)}
        kept, logits = {}, np.zeros((b, t_max, len(self.langs)), np.float32) + self.p["o"]
        for d in "fb":
            h, kept[d], outs = np.zeros((b, self.hidden), np.float32), [], []
            for t in range(t_max):
                new, *rest = self._step(d, inputs[d][:, t], h)
                kept[d].append((h, *rest))
                h = new
                outs.append(new)
            outs = np.stack(outs, axis=1)
            kept[d + "h"] = outs
            own = outs @ self.p[f"V{d}"]
            logits += own if d == "f" else np.take_along_axis(own, back[:, :, None], axis=1)
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        total = mask.sum()
        loss = -np.log(prob[np.arange(b)[:, None], np.arange(t_max)[None, :], y[:, None]] + 1e-9)[mask].mean()
        grad = prob
        grad[np.arange(b)[:, None], np.arange(t_max)[None, :], y[:, None]] -= 1
        grad *= mask[:, :, None] / total
        g = {"o": grad.sum(axis=(0, 1))}
        n = self.hidden
        for d in "fb":
            dl = grad if d == "f" else np.take_along_axis(grad, back[:, :, None], axis=1)
            g[f"V{d}"] = np.einsum("bth,btk->hk", kept[d + "h"], dl)
            down = dl @ self.p[f"V{d}"].T
            de, du, dc = np.zeros_like(self.p[f"E{d}"]), np.zeros_like(self.p[f"U{d}"]), np.zeros(n, np.float32)
            dh = np.zeros((b, n), np.float32)
            for t in range(t_max - 1, -1, -1):
                h, z, r, cand, inner = kept[d][t]
                dh = dh + down[:, t]
                dcand = dh * (1 - z) * (1 - cand * cand)
                dz = dh * (h - cand) * z * (1 - z)
                dr = dcand * inner * r * (1 - r)
                dinner = dcand * r
                pre = np.concatenate([dz, dr, dcand], axis=1)
                np.add.at(de, inputs[d][:, t], pre)
                rec = np.concatenate([dz, dr, dinner], axis=1)
                du += h.T @ rec
                dc += dinner.sum(axis=0)
                dh = dh * z + rec @ self.p[f"U{d}"].T
            g |= {f"E{d}": de, f"U{d}": du, f"c{d}": dc}
        return float(loss), g

    def fit(self, samples: list[tuple[bytes, int]], steps: int = 500, batch: int = 128, rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over random batches of the samples (stretches of at most ``span`` bytes, language index); the loss of each step."""
        rng, losses = np.random.default_rng(seed), []
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        x = np.zeros((len(samples), self.span), np.uint8)
        lengths = np.array([len(s[: self.span]) for s, _ in samples], np.int64)
        for i, (s, _) in enumerate(samples):
            x[i, : lengths[i]] = np.frombuffer(s[: self.span], np.uint8)
        y = np.array([k for _, k in samples], np.int64)
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(samples), min(batch, len(samples)))
            loss, grads = self._grads(x[rows], lengths[rows], y[rows])
            norm = np.sqrt(sum(float((q * q).sum()) for q in grads.values()))
            now = rate * (1 - step / (steps + 1)) ** 0.5
            for k, q in grads.items():
                q = q * min(1.0, 5.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.99 * v[k] + 0.01 * q * q
                self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        return losses

    # -- prediction ----------------------------------------------------------------------------------------------

    def _stretches(self, n: int) -> np.ndarray:
        """Bounds of n bytes cut into stretches of nearly equal length."""
        k = -(-n // self.span)
        return np.arange(k + 1) * n // k

    def _walker(self, d: str, size: int) -> Callable[[np.ndarray, np.ndarray], None]:
        """A function that moves states h (at most ``size`` rows) on by bytes x, in place: ``_step`` in buffers of its own.

        A sigmoid divides by 1 + exp(-x), and tanh(x) is 1 - 2 / (exp(2 x) + 1), for np.tanh takes twice the time of np.exp.
        The factors -1 and 2 are in the weights, where they change no rounding.  Each gate has arrays of its own, so all
        of them are contiguous.
        """
        n, p = self.hidden, self.p
        factors = np.array([-1, -1, 2], np.float32)
        (ez, er, en), (uz, ur, un) = ([np.ascontiguousarray(p[f"{name}{d}"][:, k * n : (k + 1) * n]) * factors[k] for k in range(3)] for name in "EU")
        c = p[f"c{d}"] * factors[2]
        own = [np.empty((size, n), np.float32) for _ in range(4)]

        def walk(x: np.ndarray, h: np.ndarray) -> None:
            z, r, cand, part = (b[: len(h)] for b in own)
            for out, e, u in ((z, ez, uz), (r, er, ur)):
                e.take(x, axis=0, out=out, mode="clip")
                np.matmul(h, u, out=part)
                out += part
                np.exp(out, out=out)
                out += 1
            np.matmul(h, un, out=part)
            part += c
            part /= r
            en.take(x, axis=0, out=cand, mode="clip")
            cand += part
            np.exp(cand, out=cand)
            cand += 1
            np.divide(-2, cand, out=cand)
            cand += 1
            h -= cand
            h /= z
            h += cand

        return walk

    def _block(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
        """Summed position probabilities (S, K) of stretches of data, longest first; fills labels by position if given."""
        s, t_max = len(start), int(length[0])
        active = np.searchsorted(-length, -np.arange(t_max), side="left")  # stretches longer than t
        x = np.zeros((t_max, s), np.intp)
        for t in range(t_max):
            x[t, : active[t]] = data[start[: active[t]] + t]
        forward, k = np.empty((t_max, len(self.langs), s), np.float32), len(self.langs)  # languages by stretches
        vf, vb, o = self.p["Vf"].T, self.p["Vb"].T, self.p["o"][:, None]
        h, walk = np.zeros((s, self.hidden), np.float32), self._walker("f", s)
        for t in range(t_max):
            a = active[t]
            walk(x[t, :a], h[:a])
            np.add(vf @ h[:a].T, o, out=forward[t, :, :a])
        sums, h, walk = np.zeros((k, s), np.float32), np.zeros((s, self.hidden), np.float32), self._walker("b", s)
        for t in range(t_max - 1, -1, -1):
            a = active[t]
            walk(x[t, :a], h[:a])
            score = vb @ h[:a].T
            score += forward[t, :, :a]
            score -= score.max(axis=0)
            np.exp(score, out=score)
            score /= score.sum(axis=0)
            sums[:, :a] += score
            if labels is not None:
                labels[start[:a] + t] = score.argmax(axis=0)
        return sums.T

    def _run(self, texts: list[bytes], labels: np.ndarray | None = None, block: int = 3072) -> np.ndarray:
        data = np.frombuffer(b"".join(texts), np.uint8)
        bounds, owner, base = [], [], 0
        for i, text in enumerate(texts):
            if text:
                cut = base + self._stretches(len(text))
                bounds.append(np.stack([cut[:-1], np.diff(cut)]))
                owner.append(np.full(len(cut) - 1, i))
                base += len(text)
        total = np.zeros((len(texts), len(self.langs)), np.float64)
        if bounds:
            (start, length), owner = np.concatenate(bounds, axis=1), np.concatenate(owner)
            order = np.argsort(-length, kind="stable")
            with np.errstate(over="ignore"):  # exp of large arguments is infinite, and what it divides is then 0
                for at in range(0, len(order), block):
                    rows = order[at : at + block]
                    np.add.at(total, owner[rows], self._block(data, start[rows], length[rows], labels))
        return total / np.maximum([[len(t)] for t in texts], 1)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean over all positions of each whole text (rows of zeros for empty ones)."""
        out, at = np.zeros((len(texts), len(self.langs))), 0
        while at < len(texts):  # a few MB at a time
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= 2 << 20):
                size += len(texts[end])
                end += 1
            out[at:end] = self._run(texts[at:end])
            at = end
        return out

    def position_labels(self, text: bytes) -> list[str]:
        """The likeliest language at every byte of text."""
        labels = np.zeros(len(text), np.int64)
        self._run([text], labels)
        return [self.langs[k] for k in labels]


def sample_stretches(labelled: DataFrame, per_class: int, span: int, each: int = 8, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> list[tuple[str, str]]:
    """About per_class (lang, stretch) of each language: rows by a hash of their id, stretches at hashed places of each.

    A row gives one stretch of ``span`` characters, or up to ``each`` where a language has few rows.  The driver
    receives per_class stretches a language, whatever the corpus.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col)).alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return []
    scale = 1 << 30
    by_lang = lambda value: F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, value(n))])[F.col("lang")]
    share, times = by_lang(lambda n: int(min(1.0, 1.3 * per_class / n) * scale)), by_lang(lambda n: max(1, min(each, per_class // n)))
    picked = rows.where((F.pmod(F.col("h"), F.lit(scale)) < share) & F.col("text").rlike(HAS_LETTER))
    place = lambda k: (F.pmod(F.xxhash64("h", k), F.greatest(F.length("text") - span, F.lit(1))) + 1).cast("int")
    cuts = F.transform(F.sequence(F.lit(1), times), lambda k: F.substring(F.col("text"), place(k), F.lit(span)))
    found = picked.select("lang", "h", F.posexplode(cuts).alias("k", "stretch")).collect()
    taken, out = Counter(), []
    for r in sorted(found, key=lambda r: (r["h"], r["lang"], r["k"], r["stretch"])):
        if taken[r["lang"]] < per_class:
            taken[r["lang"]] += 1
            out.append((r["lang"], r["stretch"]))
    return out


def train(labelled: DataFrame, per_class: int = 1200, hidden: int = 16, span: int = 96, steps: int = 500, **cols) -> ByteTagger | None:
    """A tagger fitted to a bounded sample of labelled rows; None if no row has a label."""
    in_small_batches(labelled.sparkSession)
    samples = sample_stretches(labelled, per_class, span, **cols)
    if not samples:
        return None
    model = ByteTagger(sorted({lang for lang, _ in samples}), hidden, span)
    model.fit([(s.encode("utf-8", "replace"), model.langs.index(lang)) for lang, s in samples if s], steps)
    return model


def predict(text: Column, model: ByteTagger | None) -> Column:
    """struct(lang string, score double) of whole texts: ``und`` and 0 if text is null, has no letter, or nothing was learned."""

    @F.pandas_udf("lang string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lang, score = np.full(len(batch), UNDETERMINED, object), np.zeros(len(batch))
            known = np.flatnonzero(batch.notna().to_numpy())
            if model and len(known):
                prob = model.probabilities([bytes(batch.iloc[i]) for i in known])
                lang[known] = np.array(model.langs, object)[prob.argmax(axis=1)]
                score[known] = np.clip(prob.max(axis=1), 0, 1)
            yield pd.DataFrame({"lang": lang, "score": score})

    # Marked nondeterministic: a filter on the result must not run the network a second time.
    return run.asNondeterministic()(F.when(text.rlike(HAS_LETTER), text.cast("binary")))


def identify(df: DataFrame, per_class: int = 1200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the labelled rows that are not held out.

    held_out: crc32 of the id as text, modulo 4, is 2.  Rows without an id are neither held out nor learned from.
    Only the text enters a prediction, and all of it, however long.  Null texts and texts without a letter are ``und`` with
    score 0; of equal probabilities the first language by name counts.  Repeated rows come back as often as they occur;
    other columns are ignored; without labels every text is ``und``; an empty df gives no rows.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % 4
    model = train(df.where(fold.isNotNull() & (fold != 2)), per_class, id_col=id_col, text_col=text_col, lang_col=lang_col)
    found = df.select(F.col(id_col).alias("doc_id"), F.coalesce(fold == 2, F.lit(False)).alias("held_out"), predict(F.col(text_col), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
