"""Language identification by a bidirectional gated recurrent network over bytes.

Two GRUs read the UTF-8 bytes of the lower-cased text, one from each end of a window; a soft-max over both states labels
every position. A document's probabilities are the mean over all its positions that belong to a letter. The network is
trained here, in numpy, by backpropagation through time on a bounded sample. Whole texts are labelled: a text is cut
into windows without a rest, and each window is read from the zero state, so neither batches nor partitions matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import documents, release_memory

UNKNOWN = "und"
PAD = 256
WINDOW = 128
HIDDEN = 12
#: Bounds of the training sample: documents of a language, characters of a document, and documents in all (one of each language at least).
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL = 500, 240, 32_000
#: Windows of one forward pass: few enough for a step's arrays to stay in a core's cache.
BATCH = 1024
#: Least number of training steps, for small samples.
STEPS = 240
_LETTER = re.compile(r"[^\W\d_]")


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def training_sample(docs: DataFrame, label: str, per_label: int, chars: int, total: int) -> DataFrame:
    """At most `per_label` rows (label, piece) of each label, in a fixed pseudo-random order.

    No label is left out: where there are so many that the rows would come to more than `total`, each has fewer rows,
    and one at least. `docs` has doc_id, text and the label. Counts come first, so that a hash threshold leaves about three times the
    rows wanted (and 30 more, so that chance leaves no label out) and the final cut per label sorts those alone, however large the table is.
    """
    rows = docs.filter(F.col(label).isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    counts = rows.groupBy(label).count().orderBy(label).collect()
    per_label = max(1, min(per_label, total // max(1, len(counts))))
    if not counts:
        return rows.select(F.col(label).alias("label"), F.lit("").alias("piece")).limit(0)
    share = F.create_map(*[x for r in counts for x in (F.lit(r[label]), F.lit(min(1.0, (3.0 * per_label + 30) / r["count"])))])
    order = F.xxhash64(F.col("doc_id"), F.xxhash64("text"))
    draw = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    start = F.pmod(F.xxhash64(order), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    rows = rows.withColumn("_share", F.coalesce(F.element_at(share, F.col(label)), F.lit(0.0))).filter(draw < F.col("_share"))
    rows = rows.select(F.col(label).alias("label"), order.alias("_order"), F.substr("text", start, F.lit(chars)).alias("piece"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("label").orderBy("_order", "piece"))).filter(F.col("_nth") <= per_label)
    return rows.orderBy("label", "_order", "piece").select("label", "piece")


def _letters(x):
    """Positions that belong to a letter: ASCII letters and every byte of other characters."""
    return ((x >= 97) & (x <= 122)) | ((x >= 65) & (x <= 90)) | ((x >= 128) & (x < PAD))


class ByteGru:
    """Parameters: per direction input table E (byte -> update, reset, candidate), recurrence U and candidate bias b; then the soft-max."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 7):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.p = {"V": rng.normal(0, 0.3, (2 * hidden, len(labels))), "c": np.zeros(len(labels))}
        for d in "fb":
            self.p |= {f"E{d}": rng.normal(0, 0.3, (PAD + 1, 3 * hidden)), f"U{d}": rng.normal(0, hidden**-0.5, (hidden, 3 * hidden)), f"b{d}": np.zeros(hidden)}
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x, d: str, trace: list | None = None):
        """States after each step of x (steps, batch) in reading order; padding keeps the zero state."""
        import numpy as np

        n, table, u, bias = self.hidden, self.p[f"E{d}"], self.p[f"U{d}"], self.p[f"b{d}"]
        h = np.zeros((x.shape[1], n), np.float32)
        out = np.empty((*x.shape, n), np.float32)
        half = np.float32(0.5)
        for t in range(len(x)):
            a, rec = table[x[t]], h @ u
            gates = a[:, : 2 * n] + rec[:, : 2 * n]
            gates *= half
            np.tanh(gates, out=gates)
            gates += 1
            gates *= half
            z, r = gates[:, :n], gates[:, n:]
            inner = rec[:, 2 * n :] + bias
            new = np.tanh(a[:, 2 * n :] + r * inner)
            before, h = h, new + z * (h - new)
            if (pad := x[t] == PAD).any():
                h[pad] = 0
            out[t] = h
            if trace is not None:
                trace.append((before, z, r, new, inner))
        return out

    def states(self, x):
        """States (steps, batch, hidden) at every position of x (steps, batch), from the left and from the right; the same as two `_run`s.

        A step takes both directions at once. With the gates' inputs and all of the recurrence halved beforehand, a
        gate is (1 + tanh) / 2, and half of it falls together with the halves around it. Each gate has an array of its
        own, so all arithmetic runs over whole arrays and not over a few units of a row at a time.
        """
        import numpy as np

        n, p = self.hidden, self.p
        steps, size = x.shape
        gate = [slice(k * n, (k + 1) * n) for k in range(3)]
        table = np.concatenate([p[f"E{d}"][:, g] * np.float32(f) for g, f in zip(gate, (0.5, 0.5, 1), strict=True) for d in "fb"])
        u = np.stack([np.stack([p["Uf"][:, g], p["Ub"][:, g]]) for g in gate]) * np.float32(0.5)
        bias = np.repeat(np.stack([p["bf"], p["bb"]])[:, None] * np.float32(0.5), size, 1)
        both = np.stack([x, x[::-1]], 1)
        pad = (both == PAD).reshape(steps, -1)
        padded = pad.any(1)
        both += np.array([[0], [PAD + 1]], both.dtype)
        at = np.stack([both + np.int16(2 * k * (PAD + 1)) for k in range(3)], 1)
        out, before = np.empty((steps, 2, size, n), np.float32), np.zeros((2, size, n), np.float32)
        a, rec = np.empty((3, 2, size, n), np.float32), np.empty((3, 2, size, n), np.float32)
        gates, new = rec[:2], rec[2]
        for t in range(steps):
            h = out[t]
            np.take(table, at[t], axis=0, out=a, mode="clip")
            np.matmul(before, u, out=rec)
            gates += a[:2]
            np.tanh(gates, out=gates)
            new += bias
            np.multiply(gates[1], new, out=h)
            new += h
            new += a[2]
            np.tanh(new, out=new)
            np.subtract(before, new, out=h)
            h *= gates[0]
            h += before
            h += new
            h *= np.float32(0.5)
            if padded[t]:
                h.reshape(-1, n)[np.flatnonzero(pad[t])] = 0
            before = h
        return out[:, 0], out[::-1, 1]

    def positions(self, x):
        """Probabilities (steps, labels, batch) of every position of x (steps, batch)."""
        import numpy as np

        n = self.hidden
        forward, backward = self.states(x)
        out = np.matmul(self.p["V"][:n].T, forward.transpose(0, 2, 1))
        out += np.matmul(self.p["V"][n:].T, backward.transpose(0, 2, 1))
        out += self.p["c"][:, None]
        out -= out.max(1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(1, keepdims=True)
        return out

    def _gradients(self, x, y):
        """Mean cross-entropy of all letter positions and its gradients, through time in both directions."""
        import numpy as np

        n, grad, v = self.hidden, {}, self.p["V"]
        tf, tb = [], []
        f, b = self._run(x, "f", tf), self._run(x[::-1], "b", tb)[::-1]
        prob = f @ v[:n] + b @ v[n:] + self.p["c"]
        prob = np.exp(prob - prob.max(-1, keepdims=True))
        prob /= prob.sum(-1, keepdims=True)
        mask = _letters(x)
        total = max(1, mask.sum())
        at = np.arange(x.shape[1])
        loss = -(np.log(prob[:, at, y] + 1e-9) * mask).sum() / total
        prob[:, at, y] -= 1
        prob *= (mask / total)[..., None]
        grad["V"] = np.concatenate([np.einsum("tbn,tbc->nc", f, prob), np.einsum("tbn,tbc->nc", b, prob)])
        grad["c"] = prob.sum((0, 1))
        for d, trace, steps, dout in (("f", tf, x, prob @ v[:n].T), ("b", tb, x[::-1], (prob @ v[n:].T)[::-1])):
            u = self.p[f"U{d}"]
            du, db, da = np.zeros_like(u), np.zeros(n, np.float32), np.empty((*x.shape, 3 * n), np.float32)
            dh = np.zeros((x.shape[1], n), np.float32)
            for t in range(len(x) - 1, -1, -1):
                before, z, r, new, inner = trace[t]
                dh = dh + dout[t]
                dh[steps[t] == PAD] = 0
                dcand = dh * (1 - z) * (1 - new * new)
                dinner = dcand * r
                rec = np.concatenate([dh * (before - new) * z * (1 - z), dcand * inner * r * (1 - r), dinner], 1)
                da[t] = rec
                da[t, :, 2 * n :] = dcand
                du += before.T @ rec
                db += dinner.sum(0)
                dh = dh * z + rec @ u.T
            table = np.zeros_like(self.p[f"E{d}"])
            np.add.at(table, steps.ravel(), da.reshape(-1, 3 * n))
            grad |= {f"E{d}": table, f"U{d}": du, f"b{d}": db}
        return float(loss), grad

    def train(self, pieces: list[bytes], labels: list[int], epochs: int = 3, batch: int = 64, rate: float = 0.02, seed: int = 11) -> float:
        """Adam with a falling step over windows of the sample; gives the last epoch's mean loss."""
        import numpy as np

        x, owner = windows(pieces, WINDOW // 2)
        y = np.asarray(labels)[owner]
        rng, first, second, step = np.random.default_rng(seed), {}, {}, 0
        # Every language has the same say, however many windows it has.
        groups = [np.flatnonzero(y == k) for k in np.unique(y)]
        size, loss = max(map(len, groups)) if groups else 0, 0.0
        per_epoch = -(-size * len(groups) // batch) if groups else 0
        epochs = max(epochs, -(-STEPS // per_epoch)) if per_epoch else 0
        for epoch in range(epochs):
            order = np.stack([rng.permutation(np.resize(rng.permutation(g), size)) for g in groups], 1).ravel() if groups else np.array([], int)
            loss = 0.0
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                own, grad = self._gradients(x[some].T, y[some])
                loss += own / per_epoch
                step += 1
                now = rate * (1 - (epoch * per_epoch + at // batch) / (epochs * per_epoch + 1))
                for k, g in grad.items():
                    g = np.clip(g, -1, 1)
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    second[k] = 0.99 * second.get(k, 0) + 0.01 * g * g
                    self.p[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return loss

    def documents(self, texts: list[bytes], batch: int = BATCH):
        """Summed probabilities over letter positions (documents, labels) and the number of those positions."""
        import numpy as np

        sums, counts = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts))
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush() -> None:
            x, owner = windows([t for _, t in held], WINDOW)
            owner = np.asarray([i for i, _ in held])[owner]
            steps = np.ascontiguousarray(x.T)
            prob, mask = self.positions(steps), _letters(steps)
            prob *= mask[:, None]
            np.add.at(sums, owner, prob.sum(0).T)
            np.add.at(counts, owner, mask.sum(0))
            held.clear()

        for i, text in enumerate(texts):
            for at in range(0, len(text), batch * WINDOW):
                held.append((i, text[at : at + batch * WINDOW]))
                size += len(held[-1][1]) // WINDOW + 1
                if size >= batch:
                    flush()
                    size = 0
        if held:
            flush()
        return sums, counts


def windows(texts: list[bytes], width: int):
    """Every text in rows of `width` bytes, the last one padded, and the text each row is from."""
    import numpy as np

    rows = np.asarray([-(-len(t) // width) for t in texts], dtype=np.int64)
    out = np.full(int(rows.sum()) * width, PAD, np.int16)
    at = 0
    for t, n in zip(texts, rows.tolist(), strict=True):
        out[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * width
    return out.reshape(-1, width), np.repeat(np.arange(len(texts)), rows)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, total: int = SAMPLE_TOTAL, **options) -> ByteGru:
    """Fit the network to rows with a language that are not held out. The sample, and so the driver's share, is bounded by the three parameters; every language is learned, however many there are."""
    rows = training_sample(documents(docs, id_col, text_col, lang=lang_col), "lang", per_language, chars, total).collect()
    labels = sorted({r["label"] for r in rows})
    model = ByteGru(labels)
    if labels:
        model.train([r["piece"].lower().encode() for r in rows], [labels.index(r["label"]) for r in rows], **options)
    return model


def identify(docs: DataFrame, model: ByteGru, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, held_out, lang_pred, score (pooled probability of the prediction).

    Texts that are null or hold no letter are `und` with score 0, as is every text when no row had a label to learn.
    Rows are handled alone: no shuffle, repeated rows repeat, an empty table gives no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                texts = [t.lower() if t and _LETTER.search(t) else "" for t in some["text"].to_pylist()]
                if model.labels:
                    sums, counts = model.documents([t.encode() for t in texts])
                    best = sums.argmax(1)
                    known = counts > 0
                    pred = [model.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                    score = [min(1.0, float(s[b] / c)) if k else 0.0 for s, b, c, k in zip(sums, best, counts, known, strict=True)]
                else:
                    pred, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                yield pa.RecordBatch.from_arrays([some["doc_id"], some["held_out"], pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])
        release_memory()

    rows = documents(docs, id_col, text_col)
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")
