"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is its own features and those of the lines before and after it; the chain
adds how good and bad lines follow each other. Forward-backward gives each line's marginal, and the marginals weighted
by the lines' lengths make the document's score, after a monotone calibration learned with the chain.

Only documents carry labels. The first fit gives a document's label to all its lines; each later fit keeps a bad
document's line bad only if the chain before found it more bad than good, or the worst of its document.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import documents
from sightline.llm.langid import held_out

#: Bounds of the training sample: documents of each label and characters of a document.
SAMPLE_DOCS, SAMPLE_CHARS = 1500, 6000
THRESHOLD = 0.7
_CLASSES = ("lower", "upper", "digit", "space", "stop", "comma", "mark", "beyond")
_NAMES = [*_CLASSES, "bias", "log_length", "word_length", "words", "same_as_before", "distinct", "capital", "ends_with_stop", "marked_words", "repeated_line", "upper_words"]
FEATURES = len(_NAMES)


def _class_table():
    import numpy as np

    table = np.full(256, _CLASSES.index("mark"), np.uint8)
    for name, members in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("space", (9, 11, 12, 13, 32)), ("stop", b".:?"), ("comma", b",;'\"()-"), ("beyond", range(128, 256))):
        table[list(members)] = _CLASSES.index(name)
    return table


def line_features(texts: list[bytes]):
    """Features (lines, FEATURES), length of every line in bytes, and each text's first line; an empty text is one empty line."""
    import numpy as np

    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    text_ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    first = np.concatenate([[0], np.searchsorted(ends, text_ends)[:-1] + 1]) if len(texts) > 1 else np.zeros(1, np.int64)
    n, length = len(starts), ends - starts
    kind = _class_table()[data]
    kind[ends] = _CLASSES.index("space")
    out = np.zeros((n, FEATURES), np.float64)
    share = 1 / np.maximum(length, 1)
    for k in range(len(_CLASSES)):
        out[:, k] = np.add.reduceat(kind == k, starts, dtype=np.int64) * share
    out[:, _CLASSES.index("space")] = (np.add.reduceat(kind == _CLASSES.index("space"), starts, dtype=np.int64) - 1) * share
    put = {name: i for i, name in enumerate(_NAMES)}
    out[:, put["bias"]] = 1
    out[:, put["log_length"]] = np.log1p(length) / 6
    solid = kind != _CLASSES.index("space")
    begins = np.flatnonzero(solid & ~np.concatenate([[False], solid[:-1]]))
    if len(begins):
        stops = np.flatnonzero(solid & ~np.concatenate([solid[1:], [False]]))
        line = np.searchsorted(ends, begins)
        number = np.bincount(line, minlength=n)
        per = 1 / np.maximum(number, 1)
        # A word's signature: its letters' codes times powers of an odd number, modulo 2^64.
        spread = np.zeros(len(data), np.int64)
        spread[begins] = np.diff(np.concatenate([[0], begins]))
        place = np.arange(len(data)) - np.cumsum(spread)
        powers = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))
        signature = np.add.reduceat(np.where(solid, (data.astype(np.uint64) + np.uint64(1)) * powers[place & 63], np.uint64(0)), begins)
        same = np.zeros(len(begins), bool)
        same[1:] = (signature[1:] == signature[:-1]) & (line[1:] == line[:-1])
        order = np.lexsort((signature, line))
        fresh = np.ones(len(begins), bool)
        fresh[1:] = (signature[order][1:] != signature[order][:-1]) | (line[order][1:] != line[order][:-1])
        mark = _CLASSES.index("mark")
        out[:, put["words"]] = np.log1p(number) / 5
        out[:, put["word_length"]] = np.bincount(line, stops - begins + 1, minlength=n) * per / 10
        out[:, put["same_as_before"]] = np.bincount(line, same, minlength=n) * per
        out[:, put["distinct"]] = np.bincount(line[order], fresh, minlength=n) * per
        out[:, put["marked_words"]] = np.bincount(line, kind[stops] == mark, minlength=n) * per
        second = np.minimum(begins + 1, len(data) - 1)
        out[:, put["upper_words"]] = np.bincount(line, (kind[begins] == 1) & (kind[second] == 1), minlength=n) * per
        filled = np.flatnonzero(number)
        at = np.concatenate([[0], np.cumsum(number)])
        out[filled, put["capital"]] = kind[begins[at[filled]]] == 1
        out[filled, put["ends_with_stop"]] = kind[stops[at[filled + 1] - 1]] == _CLASSES.index("stop")
        whole = np.add.reduceat(signature * powers[(np.arange(len(begins)) - at[line]) & 63], at[filled])
        owner = np.searchsorted(first, filled, "right") - 1
        order = np.lexsort((whole, owner))
        again = np.zeros(len(filled), bool)
        again[1:] = (whole[order][1:] == whole[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        again[:-1] |= again[1:]
        out[filled[order], put["repeated_line"]] = again
    return out, length, first


def with_neighbours(x, first):
    """Each line's features, then those of the line before and the line after it in its text (zeros where there is none)."""
    import numpy as np

    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[first] = 0
    after[first[1:] - 1] = 0
    after[-1] = 0
    return np.concatenate([x, before, after], 1)


class LineChain:
    """Two states, 0 bad and 1 good. `w` weighs features for good; `pair[a, b]` scores state b after state a; `scale` calibrates."""

    def __init__(self):
        import numpy as np

        self.w, self.pair, self.scale = np.zeros(3 * FEATURES), np.zeros((2, 2)), np.array([1.0, 0.0])

    def _chains(self, unary, first):
        """Forward-backward for all texts side by side: marginals of good, pair marginals summed, and log-partitions."""
        import numpy as np

        n, sizes = len(unary), np.diff(np.concatenate([first, [len(unary)]]))
        order = np.argsort(-sizes, kind="stable")
        start, size = first[order], sizes[order]
        score = np.stack([np.zeros(n), unary], 1)
        alpha, beta = score.copy(), np.zeros((n, 2))
        steps = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(steps), "left")
        for t in range(1, steps):
            at = start[: alive[t]] + t
            alpha[at] += np.logaddexp(alpha[at - 1, 0, None] + self.pair[0], alpha[at - 1, 1, None] + self.pair[1])
        for t in range(steps - 2, -1, -1):
            at = start[: alive[t + 1]] + t
            following = score[at + 1] + beta[at + 1]
            beta[at] = np.logaddexp(self.pair[:, 0] + following[:, 0, None], self.pair[:, 1] + following[:, 1, None])
        last = first + sizes - 1
        z = np.logaddexp(alpha[last, 0], alpha[last, 1])
        whole = np.repeat(z, sizes)
        good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - whole, 0))
        inner = np.ones(n, bool)
        inner[last] = False
        i = np.flatnonzero(inner)
        pairs = np.exp(alpha[i][:, :, None] + self.pair[None] + (score[i + 1] + beta[i + 1])[:, None, :] - whole[i][:, None, None]).sum(0)
        return good, pairs, z

    def fit(self, x, first, state, steps: int = 300, rate: float = 0.05, decay: float = 1e-4) -> None:
        """Maximum conditional likelihood of the given line states, by Adam on the whole sample."""
        import numpy as np

        inner = np.ones(len(x), bool)
        inner[first[1:] - 1] = False
        inner[-1] = False
        i = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (state[i], state[i + 1]), 1)
        first_m, second_m = [0.0, 0.0], [0.0, 0.0]
        for step in range(1, steps + 1):
            good, pairs, _ = self._chains(x @ self.w, first)
            grads = (x.T @ (good - state) / len(x) + decay * self.w, (pairs - seen) / len(x) + decay * self.pair)
            for k, (p, g) in enumerate(zip((self.w, self.pair), grads, strict=True)):
                first_m[k] = 0.9 * first_m[k] + 0.1 * g
                second_m[k] = 0.99 * second_m[k] + 0.01 * g * g
                p -= rate * (first_m[k] / (1 - 0.9**step)) / (np.sqrt(second_m[k] / (1 - 0.99**step)) + 1e-8)

    def train(self, texts: list[bytes], labels: list[int], fits: int = 3, good_share: float | None = None) -> None:
        """`good_share`: documents of label 1 among all labelled ones, where the sample holds the labels in another proportion."""
        import numpy as np

        plain, length, first = line_features(texts)
        x, y = with_neighbours(plain, first), np.asarray(labels)
        sizes = np.diff(np.concatenate([first, [len(x)]]))
        owner = np.repeat(np.arange(len(y)), sizes)
        state = y[owner]
        for k in range(fits):
            self.fit(x, first, state)
            if k + 1 < fits:
                good, _, _ = self._chains(x @ self.w, first)
                worst = np.minimum.reduceat(good, first)
                state = np.where((y[owner] == 0) & ((good < 0.5) | (good <= worst[owner])), 0, 1)
        raw = self._raw(x, length, first)
        # Logistic calibration of the document's logit, each label weighted to its share among all labelled documents.
        share = y.mean() if good_share is None else good_share
        weight = np.where(y == 1, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))
        a = np.array([1.0, 0.0])
        f = np.stack([raw, np.ones(len(raw))], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-f @ a))
            hess = (f * (weight * p * (1 - p))[:, None]).T @ f + 1e-3 * np.eye(2)
            a -= np.linalg.solve(hess, f.T @ (weight * (p - y)) + 1e-3 * (a - [1.0, 0.0]))
        self.scale = np.array([max(a[0], 1e-3), a[1]])

    def _raw(self, x, length, first):
        """Logit of the length-weighted mean marginal."""
        import numpy as np

        good, _, _ = self._chains(x @ self.w, first)
        weight = length + 1.0
        mean = np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def scores(self, texts: list[bytes]):
        import numpy as np

        x, length, first = line_features(texts)
        return 1 / (1 + np.exp(-(self._raw(with_neighbours(x, first), length, first) * self.scale[0] + self.scale[1])))

    def line_marginals(self, text: str) -> list[tuple[str, float]]:
        x, _, first = line_features([text.encode()])
        good, _, _ = self._chains(with_neighbours(x, first) @ self.w, first)
        return list(zip(text.split("\n"), good.tolist(), strict=True))


def first_of(rows: DataFrame, order, n: int) -> DataFrame:
    """The first `n` rows of each label in `order`."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy("label").orderBy(order))).filter(F.col("_nth") <= n).drop("_nth")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> LineChain:
    """Fit the chain to labelled rows that are not held out; the sample, and so the driver's share, is bounded by both parameters."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & ~held_out(F.col("_id"))).distinct()
    shares = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}
    chain = LineChain()
    if len(shares) < 2:
        return chain
    # Ids are drawn first: two labels times `per_label` of them at most, so they may be broadcast and no text is shuffled.
    order = F.xxhash64(F.col("_id"))
    part = F.when(F.col("label") == 1, min(1.0, 3.0 * per_label / shares[1])).otherwise(min(1.0, 3.0 * per_label / shares[0]))
    drawn = first_of(marks.filter(F.pmod(order, F.lit(1 << 30)) / float(1 << 30) < part), order, per_label)
    rows = documents(docs, id_col, text_col).join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).filter(F.length("text") > 0)
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - chars + 1, F.lit(1))).cast("int") + 1
    rows = rows.select("label", "doc_id", F.substr("text", start, F.lit(chars)).alias("piece"))
    rows = first_of(rows, F.xxhash64("doc_id", "piece"), per_label).orderBy("label", "doc_id", "piece").collect()
    if len({r["label"] for r in rows}) == 2:
        chain.train([r["piece"].encode() for r in rows], [r["label"] for r in rows], good_share=shares[1] / sum(shares.values()))
    return chain


def score(docs: DataFrame, chain: LineChain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: doc_id, held_out, score (0..1, higher: label 1 likelier), predicted.

    A null or empty text is one empty line and gets that line's score. Rows are handled alone: no shuffle, repeated
    rows repeat, an empty table gives no rows. With labels of one kind only, every score is 0.5.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            at = 0
            texts = [(t or "").encode() for t in batch["text"].to_pylist()]
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= 1 << 21):
                    size += len(texts[end])
                    end += 1
                got = pa.array(chain.scores(texts[at:end]), pa.float64())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, end - at), batch["held_out"].slice(at, end - at), got], ["doc_id", "held_out", "score"])
                at = end

    rows = documents(docs, id_col, text_col)
    rows = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
