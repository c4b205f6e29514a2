"""Secrets: fixed patterns, and a character convolutional network over every candidate in its context.

The patterns (assign, access, hex) decide the base spans, which always stay. Candidates are all base spans and
every other run of ``[A-Za-z0-9+/_=.-]`` of at least ``LEAST`` characters that mixes letters and digits. Each is
read with ``CONTEXT`` characters on both sides; longer runs in overlapping slices, of which the highest score
counts. The network (one convolution, maximum and mean over the places, one layer) is trained in NumPy on
labelled findings drawn from a fixed seed: keys and tokens of many shapes against names, paths, versions, hashes
of files, numbers. On findings that were not learned from, its scores are calibrated (a scale and an offset that
minimise the logistic loss) and the threshold is the highest that still finds ``RECALL`` of them, but at least
one half. Candidates at or above the threshold that overlap no base span become spans of kind ``token``.

Texts are read whole, and documents never move between tasks.

Defined cases: null texts are empty and have no spans; ``mask_secrets`` leaves them null. Rows with one doc_id
are handled each by itself. Other columns are ignored by ``secrets`` and kept by ``mask_secrets``.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{24,}")  # maximal runs: shorter ones fail anyhow
LEAST, CONTEXT, SLICE, RECALL, FILTERS, SPAN = 16, 16, 48, 0.98, 24, 5
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % LEAST)
DIGIT = re.compile("[0-9]")
LENGTH = SLICE + 2 * CONTEXT
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=.-:\"' \n()[]{}<>,;@#$%&*!?|\\"
OUTSIDE, OTHER = len(ALPHABET), len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns by start, then kind as listed; leftmost, without overlap inside a kind."""
    spans = []
    if "=" in text or ":" in text:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if DIGIT.search(text) or len(text) >= 24:
        spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base) -> list[tuple[int, int]]:
    """Other runs that the network looks at."""
    if not DIGIT.search(text):
        return []
    return [m.span() for m in RUN.finditer(text)
            if DIGIT.search(m[0]) and re.search("[A-Za-z]", m[0]) and all(m.end() <= a or b <= m.start() for _, a, b in base)]


def encoded(text: str, a: int, b: int) -> np.ndarray:
    """One row per slice of ``text[a:b]`` with its context: symbols, and a flag whether a place is inside."""
    rows = []
    for s in range(a, max(b - SLICE // 2, a + 1), SLICE // 2):
        e = min(s + SLICE, b)
        row = np.full((2, LENGTH), OUTSIDE, np.int64)
        left = text[max(0, s - CONTEXT):s]
        piece = left + text[s:e] + text[e:e + CONTEXT]
        start = CONTEXT - len(left)
        row[0, start:start + len(piece)] = [CODE.get(c, OTHER) for c in piece]
        row[1] = 0
        row[1, CONTEXT:CONTEXT + e - s] = 1
        rows.append(row)
    return np.stack(rows)


CODE = {c: i for i, c in enumerate(ALPHABET)}


class Network:
    """``table[k]``: what a symbol (twice: outside or inside the candidate) adds to each filter at offset k."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"table": r.normal(0, 0.2, (SPAN, 2 * (OTHER + 1), FILTERS)), "shift": np.zeros(FILTERS),
                  "top": r.normal(0, 0.2, 2 * FILTERS), "offset": np.zeros(1)}
        self.scale, self.bias, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        symbol = x[:, 0] + x[:, 1] * (OTHER + 1)
        places = LENGTH - SPAN + 1
        z = self.p["shift"] + sum(self.p["table"][k][symbol[:, k:k + places]] for k in range(SPAN))
        a = np.maximum(z, 0)
        inside = x[:, 1, SPAN // 2:SPAN // 2 + places, None]
        mean = (a * inside).sum(1) / np.maximum(inside.sum(1), 1)
        pooled = np.concatenate([a.max(1), mean], axis=1)
        return symbol, z, a, inside, pooled, pooled @ self.p["top"] + self.p["offset"]

    def step(self, x: np.ndarray, y: np.ndarray) -> dict:
        """Gradient of the logistic loss."""
        symbol, z, a, inside, pooled, logit = self._forward(x)
        d = (1 / (1 + np.exp(-logit)) - y) / len(y)
        grad = {"top": pooled.T @ d, "offset": np.array([d.sum()]), "table": np.zeros_like(self.p["table"])}
        dp = d[:, None] * self.p["top"]
        da = dp[:, None, FILTERS:] * inside / np.maximum(inside.sum(1, keepdims=True), 1)
        at = a.argmax(1)
        rows, filters = np.arange(len(y))[:, None], np.arange(FILTERS)
        da[rows, at, filters] += dp[:, :FILTERS]
        dz = da * (z > 0)
        grad["shift"] = dz.sum((0, 1))
        for k in range(SPAN):
            np.add.at(grad["table"][k], symbol[:, k:k + dz.shape[1]].ravel(), dz.reshape(-1, FILTERS))
        return grad

    def logits(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        return np.concatenate([self._forward(x[i:i + block])[-1] for i in range(0, len(x), block)] or [np.zeros(0)])

    def scores(self, found: list[tuple[str, int, int]]) -> np.ndarray:
        """Calibrated score of each ``(text, start, end)``."""
        if not found:
            return np.zeros(0)
        rows = [encoded(*f) for f in found]
        first = np.cumsum([0] + [len(r) for r in rows[:-1]])
        logit = np.maximum.reduceat(self.logits(np.concatenate(rows)), first)
        return 1 / (1 + np.exp(-(self.scale * logit + self.bias)))


def labelled_findings(count: int, seed: int = 17):
    """``(text, start, end, label)``: candidates in context, label 1 for secrets."""
    r = random.Random(seed)
    chars = {"mixed": string.ascii_letters + string.digits, "hex": "0123456789abcdef", "upper": string.ascii_uppercase + string.digits,
             "base64": string.ascii_letters + string.digits + "+/", "url": string.ascii_letters + string.digits + "-_", "lower": string.ascii_lowercase}

    def draw(kind, n):
        return "".join(r.choices(chars[kind], k=n))

    def word(low=3, high=9):
        return draw("lower", r.randrange(low, high))

    def number(n=4):
        return str(r.randrange(1, 10 ** n))

    def secret():
        shape = r.randrange(0, 7)
        n = r.randrange(20, 56)
        return [lambda: draw("mixed", n), lambda: draw("base64", n) + r.choice(["", "=", "=="]), lambda: draw("url", n),
                lambda: r.choice(["sk", "pk", "ghp", "xoxb", "key", "glpat"]) + r.choice(["_", "-"]) + draw("mixed", n), lambda: "AKIA" + draw("upper", 16),
                lambda: draw("hex", r.choice([32, 40, 64])), lambda: ".".join(draw("url", r.randrange(16, 30)) for _ in range(3))][shape]()

    def harmless():
        shape = r.randrange(0, 8)
        return [lambda: "/".join(word() for _ in range(3)) + "/" + word() + number(), lambda: "-".join(word() for _ in range(3)) + "-" + number(3),
                lambda: f"{word()}.{word()}.example.com/{word()}{number(3)}", lambda: "_".join(word() for _ in range(3)) + number(2),
                lambda: f"{r.randrange(1990, 2030)}-{r.randrange(10, 13)}-{r.randrange(10, 29)}T{number(2)}-{word()}", lambda: word(8, 12) + "=" * r.randrange(4, 9) + number(3),
                lambda: word() + "." * r.randrange(9, 20) + number(3), lambda: word(9, 14) + number(9) + word(3, 6)][shape]()
    for _ in range(count):
        label = int(r.random() < 0.5)
        value = secret() if label else harmless()
        while len(value) < LEAST:
            value += word()
        hint = r.choice(["key", "token", "auth", "secret", "bearer", "credential"]) if r.random() < (0.5 if label else 0.1) else word()
        left = f"{' '.join(word() for _ in range(3))} {hint}{r.choice([' ', ': ', '=', ' = ', ' ' + chr(34)])}"
        text = left + value + r.choice([" ", chr(34) + " ", ", ", ".\n", ") "]) + " ".join(word() for _ in range(3))
        yield text, len(left), len(left) + len(value), label


@lru_cache(maxsize=2)
def trained(steps: int = 150, batch: int = 64, seed: int = 17, recall: float = RECALL) -> Network:
    """The network after ``steps`` batches (Adam), calibrated on findings of its own; the same for equal arguments."""
    network, found = Network(), labelled_findings(steps * batch, seed)
    first, second = ({k: np.zeros_like(v) for k, v in network.p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        part = [next(found) for _ in range(batch)]
        rows = [encoded(*f[:3]) for f in part]
        y = np.repeat([f[3] for f in part], [len(r) for r in rows]).astype(float)
        for k, g in network.step(np.concatenate(rows), y).items():
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g ** 2
            network.p[k] -= 0.02 * first[k] / (1 - 0.9 ** t) / (np.sqrt(second[k] / (1 - 0.99 ** t)) + 1e-8)
    held = list(labelled_findings(2000, seed + 1))
    y = np.array([f[3] for f in held], float)
    p = np.clip(network.scores([f[:3] for f in held]), 1e-9, 1 - 1e-9)
    logit = np.log(p / (1 - p))
    scale, bias = 1.0, 0.0
    for _ in range(50):  # Newton steps
        q = 1 / (1 + np.exp(-(scale * logit + bias)))
        a, w = np.stack([logit, np.ones_like(logit)]), q * (1 - q)
        scale, bias = np.array([scale, bias]) - np.linalg.solve((a * w) @ a.T + 1e-2 * np.eye(2), a @ (q - y) + 1e-2 * np.array([scale - 1, bias]))
    network.scale, network.bias = float(scale), float(bias)
    positive = np.sort(network.scores([f[:3] for f in held])[y == 1])
    network.threshold = max(0.5, float(positive[int((1 - recall) * len(positive))]))
    return network


def all_spans(texts: list[str], network: Network):
    """``(base, all)`` spans of each text, by start, then kind."""
    base = [base_spans(t) for t in texts]
    asked = [(row, a, b) for row, t in enumerate(texts) for a, b in candidates(t, base[row])]
    score = network.scores([(texts[row], a, b) for row, a, b in asked])
    more: list[list] = [[] for _ in texts]
    for (row, a, b), s in zip(asked, score):
        if s >= network.threshold:
            more[row].append(("token", a, b))
    for found, extra in zip(base, more):
        yield found, sorted(found + extra, key=lambda s: (s[1], KINDS.index(s[0])))


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secrets(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, scores)`` of every row of ``docs(doc_id, text)``; ``scores`` are
    the calibrated scores of all spans."""
    network = trained()

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            found = list(all_spans(texts, network))
            flat = network.scores([(t, a, b) for t, (_, every) in zip(texts, found) for _, a, b in every])
            ends = np.cumsum([len(every) for _, every in found])
            scores = [np.round(flat[e - len(every):e], 4).tolist() for e, (_, every) in zip(ends, found)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS[:3]),
                 pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([listed(every) for _, every in found], pa.string()), pa.array(scores, pa.list_(pa.float64()))],
                ["doc_id", *(f"n_{k}" for k in KINDS[:3]), "base_sha256", "spans", "scores"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, scores array<double>")


def mask_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark``."""
    network = trained()

    def run(batches):
        for batch in batches:
            texts, new = batch["text"].to_pylist(), []
            for text, (_, spans) in zip(texts, all_spans([t or "" for t in texts], network)):
                parts, at = [], 0
                for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
                    parts += [text[at:a], mark] if a >= at else []
                    at = max(at, b)
                new.append(None if text is None else "".join(parts) + text[at:])
            columns = {"text": pa.array(new, batch.schema.field("text").type)}
            yield pa.RecordBatch.from_arrays([columns.get(c, batch[c]) for c in batch.schema.names], schema=batch.schema)
    return docs.mapInArrow(run, docs.schema)
