"""Personal data: fixed patterns, and a character BiLSTM with CRF transitions that adds spans.

The patterns (email, ip, card, phone) decide the base spans, which always stay. The tagger is trained in NumPy
from labelled spans: lines of invented words, numbers, dates, versions and personal data in many spellings, also such
that no pattern knows: numbers of the country without ``+``, ``(at)`` and ``[.]``, cards in odd groups
(``labelled_lines``, drawn from a fixed seed; ``tests/llm`` measures recall and false findings on lines of another seed). It reads windows of ``WINDOW`` characters that overlap by half.
Every window is decoded by Viterbi; of two windows that cover a character the one in which it lies further from
the edge decides, and equal neighbouring labels then join into spans over the whole text. Tagged spans count
if the tagger is sure of them (mean marginal probability of their kind over all tag paths of at least ``SURE``), have the parts of their kind (an address
four numbers up to 255, a card its check digit, numbers no letters) and overlap no base span.

All kinds hold a digit, an ``@`` or an ``at`` in brackets, so a window without one is outside everything and is not
decoded. Nothing else is left out; texts are read whole, and documents never move between tasks.

Defined cases: null texts are empty and have no spans; ``redact`` leaves them null. Rows with one doc_id are
handled each by itself. ``personal_data`` ignores other columns, ``redact`` keeps them; it sets ``n_chars``
to the new length where there is such a column.
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

KINDS = ("email", "ip", "card", "phone")
TAGS = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
WINDOW, HIDDEN, LINES, STEPS, BATCH, SURE = 64, 20, 9600, 500, 96, 0.55
SYMBOLS = "@.-+()/:_%,;= \n[]{}0atdo"  # the letters of at and dot; a leading zero
N_SYMBOLS = len(SYMBOLS) + 5  # digits, lower case, upper case, other ASCII, everything else
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# From maximal runs of digits only: a match from inside a run would go on as the one from its start did.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT, TRIGGER = re.compile("[0-9]"), re.compile(r"[0-9@]|[(\[{]\x20?at\x20?[)\]}]", re.IGNORECASE)
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LETTER, NUMBER, AT, HOST = re.compile(r"[^\W\d_]"), re.compile("[0-9]+"), re.compile(r"@|[(\[{]\x20?at\x20?[)\]}]", re.IGNORECASE), re.compile(r"\.|\bdot\b", re.IGNORECASE)


# --- base spans

def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(d // 5 + 2 * d % 10 for d in map(int, digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns by kind as listed, then start; leftmost, without overlap inside a kind."""
    spans = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return spans
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in _parts(m[0]))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return spans


def _parts(address: str) -> list[str]:
    return [p.lstrip("0")[:4] or "0" for p in address.split(".")]  # four digits are over 255 already


# --- labelled lines

def labelled_lines(count: int, seed: int = 11):
    """``(text, [(kind, start, end)])``: lines to learn from, with personal data and with what only looks like it."""
    r = random.Random(seed)

    def digits(n):
        return "".join(r.choices("0123456789", k=n))

    def word(low=2, high=9):
        w = "".join(r.choices(string.ascii_lowercase, k=r.randrange(low, high)))
        return w.capitalize() if r.random() < 0.15 else w

    def email():
        name = word(3, 8) + r.choice(["", ".", "_", "-", "+"]) + r.choice([word(2, 8), digits(2)])
        host = [word(3, 9) + r.choice(["", "-" + word(2, 5), "." + word(2, 5), digits(1)]), r.choice(["com", "org", "net", "io", "example", "de"])]
        if r.random() < 0.5:
            return name + "@" + ".".join(host)
        left, right = r.choice(["()", "[]", "{}"])
        gap = r.choice(["", " "])
        at = r.choice([f"{gap}{left}at{right}{gap}"] * 3 + [" @ "])
        return name + at + r.choice([".", f"{gap}{left}dot{right}{gap}", " dot "]).join(host)

    def ip():
        dot = "." if r.random() < 0.5 else r.choice(["[.]", "(.)", " . ", "[dot]", "(dot)"])
        parts = [str(r.choice([r.randrange(10), r.randrange(256), r.randrange(100, 256)])) for _ in range(4)]
        return dot.join(parts) if r.random() < 0.8 else ".".join(parts[:3]) + dot + parts[3]

    def card():
        body = digits(r.choice([12, 13, 14, 15, 15, 15, 15, 16, 18]))
        number = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        step = r.choice(["", " ", "-"]) if r.random() < 0.5 else r.choice([".", "  ", "_", "/", " - "])
        if len(number) == 15 and r.random() < 0.5:
            return step.join([number[:4], number[4:10], number[10:]])
        return step.join(number[i:i + 4] for i in range(0, len(number), 4))

    def phone():
        step = r.choice([" ", "-", "."])
        if r.random() < 0.4:
            parts = [digits(n) for n in r.choice([[3, 3, 4], [2, 4, 4], [3, 4], [2, 3, 3], [1, 2, 2, 2, 2]])]
            if r.random() < 0.25:
                parts[0] = r.choice(["(%s)", "(0)%s"]) % parts[0]
            return r.choice(["+1", "+44", "+49", "+33", "+34", "+" + digits(2)]) + r.choice([" ", "-", "", "/"]) + step.join(parts)
        area = str(r.randrange(2, 10)) + digits(2)
        code = "0" + str(r.randrange(1, 10)) + digits(r.randrange(0, 3))
        return r.choice([
            lambda: f"({area}) {digits(3)}{r.choice(' -.')}{digits(4)}", lambda: f"({area}){digits(3)}-{digits(4)}", lambda: f"{area}{step}{digits(3)}{step}{digits(4)}",
            lambda: code + r.choice([" ", "/", "-", " / "]) + digits(r.randrange(6, 9)), lambda: f"({code}) {digits(r.randrange(6, 9))}",
            lambda: f"{code} {digits(3)} {digits(r.randrange(3, 5))}", lambda: step.join([code[:2], *(digits(2) for _ in range(4))]),
            lambda: step.join(["00" + r.choice(["1", "44", "49", "33", digits(2)]), code[1:], digits(r.randrange(6, 9))]),
            lambda: step.join(["00" + digits(2), digits(3), digits(3), digits(r.randrange(2, 5))])])()

    def other():
        return r.choice([
            lambda: str(r.randrange(1, 3000)), lambda: f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.{r.randrange(1900, 2030)}", lambda: f"{r.randrange(10, 29)}{r.choice('-/')}0{r.randrange(1, 10)}{r.choice('-/')}{r.randrange(1900, 2030)}",
            lambda: f"{r.randrange(1900, 2030)}-{r.choice(['0', '1'])}{r.randrange(0, 3)}-{r.randrange(10, 29)}", lambda: f"{r.randrange(0, 24)}:{digits(2)}", lambda: f"{r.randrange(1, 20)}.{r.randrange(0, 9)}.{r.randrange(0, 9)}",
            lambda: f"{r.randrange(1, 900)},{digits(3)}", lambda: f"{r.randrange(1, 90)} {digits(3)} {digits(3)}", lambda: f"${r.randrange(1, 90)},{digits(3)},{digits(3)}.{digits(2)}", lambda: f"{digits(2)}%", lambda: "@" + word(), lambda: f"{word()} @ {word()}", lambda: f"p. {r.randrange(1, 400)}-{r.randrange(400, 900)}",
            lambda: f"({r.randrange(1, 99)})", lambda: f"({r.randrange(1900, 2030)}) {digits(3)}", lambda: digits(r.randrange(5, 12)), lambda: f"+{r.randrange(1, 99)}", lambda: f"v{r.randrange(1, 9)}.{r.randrange(0, 99)}", lambda: f"{digits(3)}{word(3, 6)}",
            lambda: f"{r.randrange(0, 99)}.{digits(r.randrange(2, 9))}", lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", lambda: f"{digits(5)}-{digits(4)}", lambda: f"{r.randrange(1, 99)}, {r.randrange(1, 99)}, {r.randrange(1, 99)}, {r.randrange(1, 99)}",
            lambda: f"{r.randrange(1, 9)}.{r.randrange(1, 9)}. {word()}", lambda: f"{word()} (at{word(2, 6)}) {word()}", lambda: f"{word()} ({word(2, 4)}) {word()} {word()}", lambda: f"{word()} [{digits(2)}] {word()}", lambda: f"{r.randrange(1900, 2030)}-{r.randrange(1900, 2030)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}",
            lambda: "".join(r.choices("0123456789abcdef", k=r.randrange(8, 33))), lambda: f"{r.randrange(1, 999)} {r.randrange(1, 999)} {r.randrange(1, 999)}", lambda: f"No. {digits(6)}/{digits(2)}"])()
    makers = dict(zip(KINDS, (email, ip, card, phone)))
    for _ in range(count):
        text, spans = "", []
        while len(text) < WINDOW:
            x = r.random()
            if x < 0.12:
                kind = KINDS[r.randrange(0, 4)]
                value = makers[kind]()
                spans.append((kind, len(text), len(text) + len(value)))
                text += value
            else:
                text += other() if x < 0.24 else word()
            text += r.choice([" ", " ", " ", " ", ", ", ". ", "\n", ": ", "; "])
        shift = r.randrange(max(1, len(text) - WINDOW))
        yield text[shift:shift + WINDOW], [(k, max(a - shift, 0), min(b - shift, WINDOW)) for k, a, b in spans if b > shift and a < shift + WINDOW]


def symbols(text: str) -> np.ndarray:
    """Kind of every character, as the tagger reads it."""
    return SYMBOL_OF[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 128)]


def _symbol_table() -> np.ndarray:
    table = np.full(129, len(SYMBOLS) + 3, np.int64)
    for i in range(128):
        c = chr(i)
        table[i] = SYMBOLS.index(c) if c in SYMBOLS else len(SYMBOLS) + (0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3)
    table[128] = len(SYMBOLS) + 4
    return table


SYMBOL_OF = _symbol_table()


# --- the tagger

def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Tagger:
    """``reads`` (input to gates), ``feeds`` (state to gates) for both directions; ``emit``, ``offset``, ``moves``
    (score of a tag after another). Gates are in the order input, forget, output, candidate."""

    def __init__(self, seed: int = 3):
        r, h = np.random.default_rng(seed), HIDDEN
        self.p = {}
        for d in "fb":
            self.p["reads" + d] = r.normal(0, 0.3, (N_SYMBOLS + 1, 4 * h))  # the last symbol stands beyond a text
            self.p["reads" + d][:, h:2 * h] += 0.5
            self.p["feeds" + d] = r.normal(0, 0.3, (h, 4 * h))
        self.p["emit"], self.p["offset"] = r.normal(0, 0.3, (2 * h, len(TAGS))), np.zeros(len(TAGS))
        self.p["moves"] = np.zeros((len(TAGS), len(TAGS)))
        for i, b in enumerate(TAGS):  # inside a kind comes only after the same kind
            for a, before in enumerate(TAGS):
                if b.startswith("I-") and before[2:] != b[2:]:
                    self.p["moves"][a, i] = -4.0
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        n, t, h = *x.shape, HIDDEN
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, trace = np.empty((n, t, h), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            z = self.p["reads" + d][x[:, i]] + state @ self.p["feeds" + d]
            gates, cand = _sigmoid(z[:, :3 * h]), np.tanh(z[:, 3 * h:])
            before, came = state, cell
            cell = gates[:, h:2 * h] * cell + gates[:, :h] * cand
            bent = np.tanh(cell)
            state = gates[:, 2 * h:] * bent
            out[:, i] = state
            if keep:
                trace.append((i, before, came, gates, cand, bent))
        return out, trace

    def emissions(self, x: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, d, False)[0] for d in "fb"], axis=2)
        return both @ self.p["emit"] + self.p["offset"]

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log-likelihood of the tags y and its gradient."""
        n, t, h = *x.shape, HIDDEN
        runs = {d: self._run(x, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        e, moves = (both @ self.p["emit"] + self.p["offset"]).astype(float), self.p["moves"].astype(float)
        fore, back = self._sums(e, moves)
        z = _logsum(fore[:, -1], 1)
        rows, places = np.arange(n)[:, None], np.arange(t)
        gold = e[rows, places, y].sum(1) + moves[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(fore + back - z[:, None, None])
        de[rows, places, y] -= 1
        pairs = np.exp(fore[:, :-1, :, None] + moves + (e[:, 1:] + back[:, 1:])[:, :, None, :] - z[:, None, None, None]).sum((0, 1))
        np.subtract.at(pairs, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        de /= n
        grad = {"moves": pairs / n, "emit": np.einsum("nth,ntk->hk", both, de), "offset": de.sum((0, 1))}
        dboth = de @ self.p["emit"].T
        for d, part in (("f", dboth[:, :, :h]), ("b", dboth[:, :, h:])):
            reads, feeds = np.zeros_like(self.p["reads" + d], float), np.zeros_like(self.p["feeds" + d], float)
            ds, dc = np.zeros((n, h)), np.zeros((n, h))
            for i, before, came, gates, cand, bent in reversed(runs[d][1]):
                ds = ds + part[:, i]
                dc = dc + ds * gates[:, 2 * h:] * (1 - bent ** 2)
                dz = np.concatenate([dc * cand, dc * came, ds * bent, dc * gates[:, :h]], axis=1)
                dz[:, :3 * h] *= gates * (1 - gates)
                dz[:, 3 * h:] *= 1 - cand ** 2
                reads += (x[:, i] == np.arange(N_SYMBOLS + 1)[:, None]).astype(float) @ dz
                feeds += before.T @ dz
                ds, dc = dz @ self.p["feeds" + d].T, dc * gates[:, h:2 * h]
            grad["reads" + d], grad["feeds" + d] = reads, feeds
        return float((z - gold).mean()), grad

    @staticmethod
    def _sums(e: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithms of the weights of all paths up to a place, and from it on."""
        fore, back = np.empty_like(e), np.zeros_like(e)
        fore[:, 0] = e[:, 0]
        for i in range(1, e.shape[1]):
            fore[:, i] = e[:, i] + _logsum(fore[:, i - 1][:, :, None] + moves, 1)
        for i in range(e.shape[1] - 2, -1, -1):
            back[:, i] = _logsum(moves + (e[:, i + 1] + back[:, i + 1])[:, None, :], 2)
        return fore, back

    def marginals(self, e: np.ndarray) -> np.ndarray:
        """Probability of every tag at every place, over all paths."""
        both = sum(self._sums(e, self.p["moves"]))
        p = np.exp(both - both.max(2, keepdims=True))
        return p / p.sum(2, keepdims=True)

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags of each row of emissions (Viterbi)."""
        n, t, k = e.shape
        best, came = e[:, 0], np.empty((n, t, k), np.int8)
        for i in range(1, t):
            paths = best[:, :, None] + self.p["moves"]
            came[:, i] = paths.argmax(1)
            best = paths.max(1) + e[:, i]
        tags = np.empty((n, t), np.int64)
        tags[:, -1] = best.argmax(1)
        for i in range(t - 1, 0, -1):
            tags[:, i - 1] = came[np.arange(n), i, tags[:, i]]
        return tags


def _logsum(x, axis):
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _tags(length: int, spans) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for kind, a, b in spans:
        y[a:b] = TAGS.index("I-" + kind)
        y[a] = TAGS.index("B-" + kind)
    return y


@lru_cache(maxsize=2)
def trained(steps: int = STEPS, seed: int = 11) -> Tagger:
    """The tagger after ``steps`` batches of labelled lines (Adam); the same for the same arguments."""
    tagger, lines = Tagger(), list(labelled_lines(LINES, seed))
    x_all = np.stack([symbols(s) for s, _ in lines])
    y_all = np.stack([_tags(WINDOW, spans) for _, spans in lines])
    r = np.random.default_rng(seed)
    for x, y in zip(x_all, y_all):  # some lines begin or end a text
        beyond = int(r.integers(1, WINDOW // 2)) * int(r.choice([-1, 0, 0, 0, 1]))
        x[:], y[:] = np.roll(x, beyond), np.roll(y, beyond)
        edge = slice(0, beyond) if beyond >= 0 else slice(beyond, None)
        x[edge], y[edge] = N_SYMBOLS, 0
    first, second = ({k: np.zeros(v.shape) for k, v in tagger.p.items()} for _ in range(2))
    for t in range(1, steps + 1):
        at = np.arange(t * BATCH, (t + 1) * BATCH) % LINES
        _, grad = tagger.step(x_all[at], y_all[at])
        size = np.sqrt(sum((g ** 2).sum() for g in grad.values()))
        rate = 0.08 * min(1.0, t / 20) * (0.1 + 0.9 * (1 - t / steps)) * min(1.0, 5.0 / (size + 1e-9))
        for k, g in grad.items():
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g ** 2
            tagger.p[k] -= (rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.99 ** t)) + 1e-8)).astype(np.float32)
    return tagger


def tagged_spans(texts: list[str], tagger: Tagger, block: int = 2048) -> list[list[tuple[str, int, int]]]:
    """Spans that the tagger is sure of, for each text."""
    half, quarter = WINDOW // 2, WINDOW // 4
    windows, where, lengths = [], [], []
    for row, text in enumerate(texts):
        lengths.append(len(text))
        marks = np.fromiter((m.start() for m in TRIGGER.finditer(text)), np.int64)
        if not len(marks):
            continue
        # windows start at multiples of half a window minus a quarter, so every character is in the middle of one
        need = np.unique(np.concatenate([(marks + d * half) // half for d in (-1, 0, 1)]))
        need = need[(need >= 0) & (need * half < len(text))]
        padded = np.full(len(text) + WINDOW * 2, N_SYMBOLS, np.int64)
        padded[quarter:quarter + len(text)] = symbols(text)
        for k in need.tolist():
            windows.append(padded[k * half:k * half + WINDOW])
            where.append((row, k * half))
    spans: list[list] = [[] for _ in texts]
    tags: dict[int, list] = {}
    for a in range(0, len(windows), block):
        e = tagger.emissions(np.stack(windows[a:a + block]))
        y = tagger.decode(e)[:, quarter:quarter + half]  # the middle of a window is its own
        p = tagger.marginals(e)[:, quarter:quarter + half]
        kind = (y + 1) // 2
        p = np.where(kind > 0, np.take_along_axis(p, y[:, :, None], 2)[:, :, 0]
                     + np.take_along_axis(p, np.where(kind > 0, np.where(y % 2 == 1, y + 1, y - 1), 0)[:, :, None], 2)[:, :, 0], 0)
        for (row, start), k, q, y_ in zip(where[a:a + block], kind, p, y):
            if k.any():
                tags.setdefault(row, []).append((start, k, q, y_))
    for row, parts in tags.items():
        n = lengths[row] + WINDOW
        kind, sure, begin = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
        for start, k, q, y_ in parts:
            kind[start:start + half], sure[start:start + half], begin[start:start + half] = k, q, (y_ % 2 == 1)
        kind[lengths[row]:] = 0
        edges = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | begin[1:]]))
        for i, j in zip(edges.tolist(), np.append(edges[1:], n).tolist()):
            if kind[i] and sure[i:j].mean() >= SURE and _plausible(KINDS[kind[i] - 1], texts[row][i:j]):
                spans[row].append((KINDS[kind[i] - 1], i, j))
    return spans


def _plausible(kind: str, value: str) -> bool:
    """Whether a tagged span has the parts of its kind, in whatever spelling."""
    runs = NUMBER.findall(value)
    digits = "".join(runs)
    if kind == "email":
        return AT.search(value, 1) is not None and HOST.search(value) is not None
    if LETTER.search(value if kind != "ip" else value.replace("dot", "")):
        return False
    if kind == "ip":
        return len(runs) == 4 and all(int(p[:4]) <= 255 for p in runs)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 7 <= len(digits) <= 15


def all_spans(texts: list[str], tagger: Tagger):
    """``(base, all)`` spans of each text; all are by kind, then start."""
    for text, more in zip(texts, tagged_spans(texts, tagger)):
        base = base_spans(text)
        free = [m for m in more if all(m[2] <= a or b <= m[1] for _, a, b in base)]
        yield base, sorted(base + free, key=lambda s: (KINDS.index(s[0]), s[1]))


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every row of ``docs(doc_id, text)``."""
    tagger = trained()

    def run(batches):
        for batch in batches:
            found = list(all_spans([t or "" for t in batch["text"].to_pylist()], tagger))
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS),
                 pa.array([hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in found], pa.string()),
                 pa.array([listed(every) for _, every in found], pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping ones the first names the place."""
    parts, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            parts += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans of ``text`` masked."""
    tagger = trained()

    def run(batches):
        for batch in batches:
            texts = batch["text"].to_pylist()
            new = [None if t is None else masked(t, spans)
                   for t, (_, spans) in zip(texts, all_spans([t or "" for t in texts], tagger))]
            columns = {"text": pa.array(new, batch.schema.field("text").type)}
            if "n_chars" in batch.schema.names:
                kind = batch.schema.field("n_chars").type
                columns["n_chars"] = pa.array([old if t == n else len(n) for old, t, n in zip(batch["n_chars"].to_pylist(), texts, new)], kind)
            yield pa.RecordBatch.from_arrays([columns.get(c, batch[c]) for c in batch.schema.names], schema=batch.schema)
    return docs.mapInArrow(run, docs.schema)
