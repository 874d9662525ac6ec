"""Secret scans: three fixed rules, and a character convolutional network over all candidates.

Candidates are long runs of token characters with a digit. The network sees each with the text
around it; it is trained on the rules' own findings (positive, also re-lettered, so that it does
not learn one alphabet) against candidates that no rule covers. Its scores are calibrated on
findings held out of training, and the decision threshold keeps a given recall there. Training and calibration
take in every distinct finding: shards of them are trained by tasks and averaged after each epoch, and the
calibration works on sums. What it finds beside the rules' findings is added; rule findings always stay.
"""

import copy
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusflow.llm.common import documents, rows_of
from corpusflow.session import materialize

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HINTS = (b"password", b"passwd", b"secret", b"token", b"api")
KINDS = ("assign", "access", "hex", "model")
LEAST = {"assign": 12, "access": 18, "hex": 16, "model": 12}

EPOCHS = 8
# Views that a shard has at least if there are several, and shards at most: their weights are averaged on the driver.
SHARD_VIEWS = 6000
MAX_SHARDS = 256
RECALL = 0.98
CONTEXT, INNER, STEP = 16, 48, 32
WIDTH = INNER + 2 * CONTEXT
REDACTED = "[SECRET]"

_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[list(b"0123456789")] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=@-")] = True


def runs(member: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least `least` bytes; none crosses a row."""
    row = rows_of(offsets)
    edge = np.ones(len(member) + 1, bool)
    edge[1:-1] = (member[1:] != member[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(edge)
    start, end = at[:-1], at[1:]
    good = member[start] & (end - start >= least)
    return start[good], end[good]


@dataclass
class Found:
    """Spans of one text in code points: by rule (kind, start, end), and the network's candidates."""

    text: str
    base: list[tuple[str, int, int]]
    values: list[tuple[int, int]]
    candidates: list[tuple[int, int]]


def scan(data: np.ndarray, offsets: np.ndarray) -> dict[int, Found]:
    """Rows with any finding or candidate."""
    if not len(data):
        return {}
    whole, lower = data.tobytes(), data.tobytes().lower()
    out: dict[int, Found] = {}
    row = rows_of(offsets)
    points = np.cumsum(np.append(0, (data & 0xC0) != 0x80))

    def of(r: int) -> Found:
        if r not in out:
            out[r] = Found(whole[offsets[r] : offsets[r + 1]].decode("utf-8", "replace"), [], [], [])
        return out[r]

    def spans(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int]]:
        r = row[start]
        first = points[offsets[r]]
        return zip(r.tolist(), (points[start] - first).tolist(), (points[end] - first).tolist(), strict=True)

    for r in range(len(offsets) - 1):
        a, b = int(offsets[r]), int(offsets[r + 1])
        if any(lower.find(hint, a, b) >= 0 for hint in HINTS):
            found = of(r)
            for m in ASSIGN.finditer(found.text):
                if m.end(2) - m.start(2) >= LEAST["assign"]:
                    found.base.append(("assign", *m.span()))
                    found.values.append(m.span(2))
        if whole.find(b"AKIA", a, b) >= 0:
            found = of(r)
            for m in ACCESS.finditer(found.text):
                if m.end() - m.start() >= LEAST["access"]:
                    found.base.append(("access", *m.span()))
                    found.values.append(m.span())
    for r, start, end in spans(*runs(_HEX[data], offsets, LEAST["hex"])):
        of(r).base.append(("hex", start, end))
        of(r).values.append((start, end))
    start, end = runs(_TOKEN[data], offsets, LEAST["model"])
    digits = np.cumsum(np.append(0, _DIGIT[data]))
    some = digits[end] > digits[start]
    for r, start, end in spans(start[some], end[some]):
        of(r).candidates.append((start, end))
    for found in out.values():
        found.base.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    return out


def overlapping(span: tuple[int, int], others: list[tuple[int, int]]) -> bool:
    return any(span[0] < b and a < span[1] for a, b in others)


def windows(text: str, start: int, end: int) -> list[str]:
    """Views of WIDTH characters over all of a candidate with its context, padded."""
    padded = []
    for at in range(start, max(start + 1, end - INNER + STEP), STEP):
        inner = text[at : min(end, at + INNER)]
        left, right = text[max(0, at - CONTEXT) : at], text[at + len(inner) : at + len(inner) + CONTEXT]
        padded.append(left.rjust(CONTEXT, "\0") + inner.ljust(INNER, "\1") + right.ljust(CONTEXT, "\0"))
    return padded


def codes(views: list[str]) -> np.ndarray:
    """Characters as 0 to 127; all beyond ASCII share one code."""
    flat = np.frombuffer("".join(views).encode("utf-32-le"), np.uint32)
    return np.where(flat < 127, flat, 127).astype(np.int64).reshape(-1, WIDTH)


class Network:
    """Embedding, one convolution, ReLU, maximum and mean over positions, logistic output."""

    def __init__(self, seed: int = 1, dim: int = 8, filters: int = 24, span: int = 5):
        rng = np.random.default_rng(seed)
        self.span, self.dim = span, dim
        self.weights = [
            rng.normal(0, 0.3, (128, dim)),
            rng.normal(0, (2 / (span * dim)) ** 0.5, (span * dim, filters)),
            np.zeros(filters),
            rng.normal(0, 0.1, 2 * filters),
            np.zeros(1),
        ]
        self.first, self.second, self.steps = [0 * w for w in self.weights], [0 * w for w in self.weights], 0
        self.scale, self.shift, self.threshold = 1.0, 0.0, 1.1

    def _forward(self, x: np.ndarray):
        embedding, kernel, bias, out, base = self.weights
        e = embedding[x]
        n = x.shape[1] - self.span + 1
        patches = np.concatenate([e[:, i : i + n] for i in range(self.span)], axis=2)
        z = (patches.reshape(-1, len(kernel)) @ kernel).reshape(*patches.shape[:2], -1) + bias
        active = np.maximum(z, 0)
        best = active.argmax(axis=1)
        pooled = np.concatenate([np.take_along_axis(active, best[:, None], 1)[:, 0], active.mean(axis=1)], axis=1)
        return patches, z, best, pooled, pooled @ out + base[0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        parts = [self._forward(x[i : i + 512])[-1] for i in range(0, len(x), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def train(self, views: list[str], y: np.ndarray, weight: np.ndarray, epochs: int, first: int = 0, batch: int = 64, rate: float = 0.005) -> None:
        """Adam on the logistic loss, from the weights and moments there are; `first` is the number of the first epoch."""
        for epoch in range(first, first + epochs):
            order = np.random.default_rng([2, epoch]).permutation(len(views))
            for at in range(0, len(views), batch):
                some = order[at : at + batch]
                gradient = self._gradient(codes([views[i] for i in some]), y[some], weight[some])
                self.steps += 1
                m, v, t = self.first, self.second, self.steps
                for i, g in enumerate(gradient):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    self.weights[i] = self.weights[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)

    def state(self) -> np.ndarray:
        """Weights and moments as one vector."""
        return np.concatenate([w.ravel() for part in (self.weights, self.first, self.second) for w in part])

    def restore(self, state: np.ndarray) -> None:
        for part in (self.weights, self.first, self.second):
            for i, w in enumerate(part):
                part[i], state = state[: w.size].reshape(w.shape), state[w.size :]

    def _gradient(self, x, y, weight):
        embedding, kernel, _, out, _ = self.weights
        patches, z, best, pooled, logit = self._forward(x)
        d = weight * (1 / (1 + np.exp(-logit)) - y) / len(x)
        filters, n = kernel.shape[1], z.shape[1]
        d_pool = d[:, None] * out
        d_active = np.repeat(d_pool[:, None, filters:] / n, n, axis=1)
        at = np.take_along_axis(d_active, best[:, None], 1) + d_pool[:, None, :filters]
        np.put_along_axis(d_active, best[:, None], at, 1)
        d_z = d_active * (z > 0)
        d_kernel = patches.reshape(-1, len(kernel)).T @ d_z.reshape(-1, filters)
        d_patches = (d_z.reshape(-1, filters) @ kernel.T).reshape(patches.shape)
        d_seen = np.zeros((*x.shape, self.dim))
        for i in range(self.span):
            d_seen[:, i : i + n] += d_patches[:, :, i * self.dim : (i + 1) * self.dim]
        place = x[:, :, None] * self.dim + np.arange(self.dim)
        d_embedding = np.bincount(place.ravel(), d_seen.ravel(), embedding.size).reshape(embedding.shape)
        return [d_embedding, d_kernel, d_z.sum((0, 1)), pooled.T @ d, np.array([d.sum()])]

    def calibrate(self, held: DataFrame, recall: float) -> None:
        """Platt scaling of `held` (y, logit) by damped Newton steps on sums over all rows, then a threshold that keeps
        the recall: from the highest such one half the way down to the next negative, which finds more and nothing false."""
        ends = held.agg(F.count("*").alias("n"), F.sum("y").alias("found"), F.stddev_pop("logit").alias("size")).first()
        size, positive = max(float(ends["size"]), 1e-9), int(ends["found"])
        # Soft targets keep the fit finite where the classes are separated.
        targets = (1 / (ends["n"] - positive + 2), (positive + 1) / (positive + 2))

        def sums(tried: list[np.ndarray]) -> np.ndarray:
            """Of each (scale, shift) the mean loss, its gradient and its second derivatives, penalty included."""

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((len(tried), 6))
                for batch in batches:
                    logit, y = batch.column("logit").to_numpy() / size, batch.column("y").to_numpy()
                    target = np.where(y == 1, targets[1], targets[0])
                    for i, w in enumerate(tried):
                        z = w[0] * logit + w[1]
                        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                        d, c = p - target, p * (1 - p)
                        parts = (np.logaddexp(0, z) - target * z, d * logit, d, c * logit * logit, c * logit, c)
                        total[i] += [x.sum() for x in parts]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(tried)), pa.int32()), *(pa.array(c) for c in total.T)], names=["i", *"abcdef"])

            found = held.mapInArrow(run, "i int, " + ", ".join(f"{c} double" for c in "abcdef")).collect()  # a few rows for each of MAX_SHARDS tasks
            total = np.zeros((len(tried), 6))
            for r in sorted(found):
                total[r[0]] += r[1:]
            return total / ends["n"]

        w = np.array([1.0, 0.0])
        here = sums([w])[0]
        for _ in range(50):
            loss, *g, h0, h1, h2 = here
            step = np.linalg.solve(np.array([[h0, h1], [h1, h2]]) + 2e-4 * np.eye(2), np.array(g) + 2e-4 * w)
            tried = [w - step / 4**i for i in range(8)]
            found = sums(tried)
            lower = np.flatnonzero(found[:, 0] + [1e-4 * x @ x for x in tried] < loss + 1e-4 * w @ w)
            if not len(lower):
                break
            w, here = tried[lower[0]], found[lower[0]]
            if np.abs(step).max() <= 1e-9:
                break
        self.scale, self.shift = w[0] / size, w[1]

        def probabilities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(self.probability(batch.column("logit").to_numpy()))], names=["y", "p"])

        p = materialize(held.mapInArrow(probabilities, "y int, p double"), "calibrated")
        highest = kth_smallest(p.where("y = 1"), "p", int((1 - recall) * positive)) if positive else 1.1
        below = p.where((F.col("y") == 0) & (F.col("p") < highest)).agg(F.max("p")).first()[0]
        self.threshold = highest if below is None else (highest + below) / 2

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -30, 30)))

    def secret(self, found: Found) -> list[tuple[int, int]]:
        """Candidates that the network takes for secrets, apart from what the rules cover."""
        taken = [(a, b) for _, a, b in found.base]
        open_ = [c for c in found.candidates if not overlapping(c, taken)]
        if not open_ or self.threshold > 1:
            return []
        views = [windows(found.text, *c) for c in open_]
        p = self.probability(self.logits(codes([v for x in views for v in x])))
        ends = np.cumsum([len(v) for v in views])
        return [c for c, a, b in zip(open_, ends - [len(v) for v in views], ends, strict=True) if p[a:b].max() >= self.threshold]


ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef")


def relettered(view: str, place: int) -> str:
    """The same finding with its value in another alphabet, by a hash of the value, and of another
    length; every other one without the text before it, so that not only the words in front decide."""
    inner = view[CONTEXT : CONTEXT + INNER].rstrip("\1")
    inner = inner[: max(LEAST["model"], len(inner) - place * 7 % 29)]
    alphabet = ALPHABETS[place % len(ALPHABETS)]
    digest = hashlib.shake_128(f"{place}:{inner}".encode()).digest(len(inner))
    before = view[:CONTEXT] if place // len(ALPHABETS) % 2 else "\0" * CONTEXT
    return before + "".join(alphabet[d % len(alphabet)] for d in digest).ljust(INNER, "\1") + view[CONTEXT + INNER :]


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in documents(batch):
            rows = []
            for found in scan(data, offsets).values():
                taken = [(a, b) for _, a, b in found.base]
                rows += [(1, v) for span in set(found.values) for v in windows(found.text, *span)]
                rows += [(0, v) for c in found.candidates if not overlapping(c, taken) for v in windows(found.text, *c)]
            rows = [(y, v.replace("\0", "\2")) for y, v in rows]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.string())], names=["y", "view"])


def kth_smallest(rows: DataFrame, name: str, k: int, bins: int = 1024) -> float:
    """The value at position k (from 0) of a column in order: counts in ever narrower bins, exact."""
    low, high = rows.agg(F.min(name), F.max(name)).first()
    while low < high:
        place = F.least(F.floor((F.col(name) - low) / (high - low) * bins), F.lit(bins - 1)).alias("bin")
        inside = rows.where((F.col(name) >= low) & (F.col(name) <= high))
        counts = inside.groupBy(place).agg(F.count("*").alias("n"), F.min(name).alias("a"), F.max(name).alias("b")).orderBy("bin").collect()
        for r in counts:
            if k < r["n"]:
                break
            k -= r["n"]
        low, high = r["a"], r["b"]
    return float(low)


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Findings with whether they are held out of training; positives come a second time, re-lettered."""
    for batch in batches:
        rows = []
        for y, view in zip(batch.column("y").to_pylist(), batch.column("view").to_pylist(), strict=True):
            digest = hashlib.md5(view.replace("\2", "\0").encode()).digest()
            held, place = digest[0] % 4 == 0, int.from_bytes(digest[1:5], "big")
            rows.append((y, view, held))
            if y:
                rows.append((1, relettered(view.replace("\2", "\0"), place).replace("\0", "\2"), held))
        columns = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["y", "view", "held"])


def _trained(network: Network, rows: DataFrame, shards: int, shares: tuple[float, float], epochs: int, first: int) -> None:
    """Some epochs in every shard of the rows (y, view, shard), then the mean of the shards by their rows."""
    shared = rows.sparkSession.sparkContext.broadcast(network)

    def run(table: pa.Table) -> pa.Table:
        # A shard's own order, whichever way its rows came.
        table = table.sort_by([("view", "ascending"), ("y", "ascending")])
        views = [v.replace("\2", "\0") for v in table["view"].to_pylist()]
        y, own = table["y"].to_numpy(), copy.deepcopy(shared.value)
        own.train(views, y, np.where(y == 1, shares[1], shares[0]), epochs, first)
        return pa.table({"shard": table["shard"][:1], "n": [len(y)], "steps": [own.steps], "state": [own.state().tolist()]})

    # At most MAX_SHARDS rows, whatever the input.
    found = rows.groupBy("shard").applyInArrow(run, "shard int, n long, steps long, state array<double>").orderBy("shard").collect()
    network.restore(np.average([r.state for r in found], axis=0, weights=[r.n for r in found]))
    network.steps = max(r.steps for r in found)


def fit(docs: DataFrame, recall: float = RECALL) -> Network:
    """Train and calibrate on all distinct findings in `docs`. With findings of one class only, the network adds nothing."""
    seen = materialize(docs.select("text").mapInArrow(_findings, "y int, view string"), "findings").distinct()
    seen = materialize(seen, "distinct-findings")
    shards = min(MAX_SHARDS, max(1, seen.count() // SHARD_VIEWS))
    rows = materialize(seen.repartition(shards, "view").mapInArrow(_labelled, "y int, view string, held boolean"), "labelled")
    counts = {(r.held, r.y): r["count"] for r in rows.groupBy("held", "y").count().collect()}
    network = Network()
    if len(counts) < 4:
        return network
    n = counts[False, 0] + counts[False, 1]
    train = rows.where("not held").select("y", "view", F.pmod(F.xxhash64("view"), F.lit(shards)).cast("int").alias("shard"))
    shares = (0.5 * n / counts[False, 0], 0.5 * n / counts[False, 1])  # both classes weigh the same
    at_once = EPOCHS if shards == 1 else 1
    for epoch in range(0, EPOCHS, at_once):
        _trained(network, train, shards, shares, at_once, epoch)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                views = [v.replace("\2", "\0") for v in batch.column("view").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(shared.value.logits(codes(views)))], names=["y", "logit"])

    held = rows.where("held").repartition(shards, "view").select("y", "view")
    network.calibrate(materialize(held.mapInArrow(logits, "y int, logit double"), "held-out"), recall)
    return network


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def secret_spans(docs: DataFrame, network: Network) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of `docs` (doc_id, text).

    Spans count code points. A null text is empty; empty texts have no spans. One row per input
    row, repeated rows and null doc_ids included; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in documents(batch):
                seen = scan(data, offsets)
                rows = []
                for r in range(last - first):
                    base, more = [], []
                    if r in seen:
                        base, more = seen[r].base, [("model", *c) for c in shared.value.secret(seen[r])]
                    digest = hashlib.sha256(joined(base).encode()).hexdigest()
                    rows.append([*(sum(k == kind for k, _, _ in base) for kind in KINDS[:3]), digest, joined(base + more)])
                columns = [pa.array([x[i] for x in rows], pa.int64() if i < 3 else pa.string()) for i in range(5)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), *columns], names=names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def redact_text(found: Found, more: list[tuple[int, int]]) -> str:
    """The text with every span replaced; overlapping spans are one."""
    out, at = [], 0
    for a, b in sorted([(a, b) for _, a, b in found.base] + more):
        if a >= at:
            out += [found.text[at:a], REDACTED]
        at = max(at, b)
    return "".join([*out, found.text[at:]])


def redact(docs: DataFrame, network: Network) -> DataFrame:
    """`docs` with every secret replaced by REDACTED; n_chars, if there, follows the text. All rows
    and all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index("text")
            kind = batch.schema.field(place).type
            for first, last, data, offsets in documents(batch):
                part = batch.slice(first, last - first)
                texts = None
                for r, found in scan(data, offsets).items():
                    more = shared.value.secret(found)
                    if found.base or more:
                        texts = part.column(place).to_pylist() if texts is None else texts
                        texts[r] = redact_text(found, more)
                yield part if texts is None else part.set_column(place, batch.schema.field(place), pa.array(texts, kind))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        size = F.when(F.col("text").isNotNull(), F.char_length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", size.cast(dict(docs.dtypes)["n_chars"]))
    return out
