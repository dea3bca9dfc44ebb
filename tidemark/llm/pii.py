"""Personal data: base patterns, and a character BiLSTM with CRF transitions.

The tagger is trained in numpy on the driver, from the spans that the base patterns label in
a bounded sample of documents, with some of them rewritten as people write them to evade
patterns. It then reads every text in overlapping windows; parts of spans that reach over the edges of windows
are joined, and spans are reconciled over the text, those of higher marginal probability
first, and added to the base spans. All kinds hold a digit or an at sign, so a window without
either is read only where a span of its neighbour goes on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.shared import free_name, pieces, text_of, texts

# The kinds in order, and the base patterns.
KINDS = ["email", "ip", "card", "phone"]
EMAIL_LEFT = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
GATE = re.compile(r"[0-9@]")

TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
HIDDEN = 16
EMBEDDED = 12
WINDOW = 96
STRIDE = 48
#: Texts that are learned from at most, those with the least hashes; and windows of them.
TRAIN_TEXTS = 600
TRAIN_WINDOWS = 900
#: Training ends after so many batches, or with a pass of at most this mean loss of a window.
STEPS = 320
ENOUGH = 0.1
#: How often few texts are drawn from again, each time rewritten anew.
DRAWS = 30
#: An added span has at least this mean marginal probability.
SURE = 0.9

#: Kind, start, end, and whether a base pattern found it.
Span = tuple[str, int, int, bool]


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the local part, an at sign and the domain; linear in the text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in EMAIL_LEFT:
            left -= 1
        found = EMAIL_RIGHT.match(text, at) if left < at else None
        if found:
            done = found.end()
            yield left, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind and start, in code points."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    if GATE.search(text):
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in CARD.finditer(text):
            d = digits_of(m.group()) if m.end() - m.start() < 40 else ""
            if 16 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m.group())) <= 15]
    return out


def char_classes() -> np.ndarray:
    """A class for each ASCII character; 0 for others. Letters of one case share classes of five."""
    out = np.zeros(128, np.int64)
    for c in range(32, 127):
        ch = chr(c)
        if ch.isdigit():
            out[c] = 1
        elif ch.islower():
            out[c] = 2
        elif ch.isupper():
            out[c] = 3
        else:
            out[c] = 4 + " !\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~".index(ch)
    return out


CLASS_OF = char_classes()
CLASSES = int(CLASS_OF.max()) + 2
PAD = CLASSES - 1


def encode(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(codes < 128, CLASS_OF[np.minimum(codes, 127)], 0)


def window_starts(classes: np.ndarray, size: int = WINDOW, stride: int = STRIDE) -> np.ndarray:
    """Starts of the windows that hold a digit or an at sign; neighbours overlap."""
    gate = np.flatnonzero((classes == 1) | (classes == CLASS_OF[ord("@")]))
    if not len(gate):
        return gate
    per = size // stride
    starts = (gate[:, None] // stride - np.arange(per)[None, :]) * stride
    return np.unique(np.maximum(starts, 0))


def cut(classes: np.ndarray, starts: np.ndarray, size: int = WINDOW) -> np.ndarray:
    padded = np.concatenate([classes, np.full(size, PAD)])
    return padded[starts[:, None] + np.arange(size)]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Tagger:
    """Embedding, an LSTM in each direction, tag scores, and CRF transitions."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        shape = {"E": (CLASSES, EMBEDDED), "O": (2 * HIDDEN, TAGS), "o": (TAGS,), "T": (TAGS, TAGS)}
        for d in "fb":
            shape |= {f"W{d}": (EMBEDDED + HIDDEN, 4 * HIDDEN), f"c{d}": (4 * HIDDEN,)}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 and k != "T" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        for d in "fb":
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first
        self.allowed = np.full((TAGS, TAGS), 0, np.float32)
        for b in range(2, TAGS, 2):  # an inside tag follows its own kind only
            self.allowed[:, b] = -1e4
            self.allowed[b, b] = self.allowed[b - 1, b] = 0

    def _lstm(self, x, d, keep):
        """Hidden states of one direction over (time, batch, embedded)."""
        steps, batch, _ = x.shape
        W, c0 = self.p[f"W{d}"], self.p[f"c{d}"]
        inside = x @ W[:EMBEDDED] + c0
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        hs, memory = np.zeros((steps, batch, HIDDEN), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inside[t] + h @ W[EMBEDDED:]
            s = sigmoid(z[:, : 3 * HIDDEN])
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :]
            g = np.tanh(z[:, 3 * HIDDEN :])
            before, past = c, h
            c = f * c + i * g
            u = np.tanh(c)
            h = o * u
            hs[t] = h
            if keep:
                memory.append((t, i, f, o, g, before, u, past))
        return hs, memory

    def scores(self, windows: np.ndarray, keep: bool = False):
        x = self.p["E"][windows.T]
        hf, mf = self._lstm(x, "f", keep)
        hb, mb = self._lstm(x, "b", keep)
        h = np.concatenate([hf, hb], axis=2)
        return h @ self.p["O"] + self.p["o"], (x, h, mf, mb)

    def _messages(self, s):
        """Log forward and backward messages and transitions, (time, batch, tag)."""
        T = self.p["T"] + self.allowed
        steps = len(s)
        a, b = np.zeros_like(s), np.zeros_like(s)
        first = np.zeros(TAGS, np.float32)
        first[2::2] = -1e4
        a[0] = s[0] + first
        for t in range(1, steps):
            a[t] = s[t] + _logsum(a[t - 1][:, :, None] + T, 1)
        for t in range(steps - 2, -1, -1):
            b[t] = _logsum(T[None] + (s[t + 1] + b[t + 1])[:, None, :], 2)
        return a, b, T, _logsum(a[-1], 1)

    def gradient(self, windows, tags):
        """Loss and gradients of a batch; ``tags`` is (batch, time)."""
        s, (x, h, mf, mb) = self.scores(windows, True)
        a, b, T, z = self._messages(s)
        gold = tags.T
        steps, batch = gold.shape
        rows = np.arange(batch)
        score = sum(s[t, rows, gold[t]] for t in range(steps)) + sum(T[gold[t], gold[t + 1]] for t in range(steps - 1))
        loss = float((z - score).mean())
        ds = np.exp(a + b - z[:, None])
        np.add.at(ds, (np.arange(steps)[:, None], rows[None, :], gold), -1)
        dT = np.zeros_like(T)
        for t in range(steps - 1):
            dT += np.exp(a[t][:, :, None] + T + (s[t + 1] + b[t + 1])[:, None, :] - z[:, None, None]).sum(axis=0)
        np.add.at(dT, (gold[:-1].reshape(-1), gold[1:].reshape(-1)), -1)
        ds /= batch
        g = {"T": dT / batch, "O": np.einsum("tbh,tbk->hk", h, ds), "o": ds.sum(axis=(0, 1))}
        dh = ds @ self.p["O"].T
        dx = np.zeros_like(x)
        for d, memory, part in (("f", mf, dh[:, :, :HIDDEN]), ("b", mb, dh[:, :, HIDDEN:])):
            W = self.p[f"W{d}"]
            dW, dc0 = np.zeros_like(W), np.zeros_like(self.p[f"c{d}"])
            back_h, back_c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
            for t, i, f, o, gg, before, u, past in reversed(memory):
                top = part[t] + back_h
                dc = back_c + top * o * (1 - u * u)
                dz = np.concatenate([dc * gg * i * (1 - i), dc * before * f * (1 - f), top * u * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                dW[:EMBEDDED] += x[t].T @ dz
                dW[EMBEDDED:] += past.T @ dz
                dc0 += dz.sum(axis=0)
                dx[t] += dz @ W[:EMBEDDED].T
                back_h, back_c = dz @ W[EMBEDDED:].T, dc * f
            g |= {f"W{d}": dW, f"c{d}": dc0}
        g["E"] = np.zeros_like(self.p["E"])
        np.add.at(g["E"], windows.T, dx)
        return loss, g

    def train(self, windows: np.ndarray, tags: np.ndarray, steps: int = STEPS, batch: int = 128, rate: float = 0.02, seed: int = 9) -> list[float]:
        """Adam over shuffled batches, as many steps whatever the number of windows; the mean loss of each pass."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses, step = [], 0
        while step < steps and not (losses and losses[-1] <= ENOUGH):
            order, total = rng.permutation(len(windows)), 0.0
            for lo in range(0, len(order), batch):
                pick = order[lo : lo + batch]
                loss, g = self.gradient(windows[pick], tags[pick])
                total += loss * len(pick)
                step += 1
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for k in self.p:
                    x = g[k] * min(1.0, 5 / (norm + 1e-12))
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    r = rate * (0.1 + 0.9 * max(0.0, 1 - step / steps))
                    self.p[k] -= (r * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / len(order))
        return losses

    def decode(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (Viterbi) and their marginal probabilities, (batch, time)."""
        s, _ = self.scores(windows)
        a, b, T, z = self._messages(s)
        steps, batch, _ = s.shape
        best, back = s[0].copy(), np.zeros((steps, batch, TAGS), np.int8)
        best[:, 2::2] -= 1e4
        for t in range(1, steps):
            options = best[:, :, None] + T
            back[t] = options.argmax(axis=1)
            best = s[t] + options.max(axis=1)
        tags = np.zeros((steps, batch), np.int64)
        tags[-1] = best.argmax(axis=1)
        rows = np.arange(batch)
        for t in range(steps - 1, 0, -1):
            tags[t - 1] = back[t][rows, tags[t]]
        sure = np.exp((a + b - z[:, None])[np.arange(steps)[:, None], rows[None, :], tags])
        return tags.T, sure.T


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def spans_of_tags(tags: np.ndarray, sure: np.ndarray) -> list[tuple[int, int, int, float]]:
    """Kind, start, end and mean probability of the runs in one window."""
    out, at = [], 0
    while at < len(tags):
        if tags[at] % 2 == 1:
            end = at + 1
            while end < len(tags) and tags[end] == tags[at] + 1:
                end += 1
            out.append((int(tags[at]) // 2, at, end, float(sure[at:end].mean())))
            at = end
        else:
            at += 1
    return out


def overlaps(a: int, b: int, taken: list[tuple[int, int]]) -> bool:
    return any(a < y and x < b for x, y in taken)


def plausible(kind: str, part: str) -> bool:
    """Whether a span of the tagger can be of its kind at all."""
    n = len(digits_of(part))
    if kind == "email":
        return len(part) >= 5 and part.count("@") == 1 and 0 < part.index("@") < len(part) - 1
    if kind == "ip":
        return n >= 4
    return 16 <= n <= 19 if kind == "card" else 8 <= n <= 15


def find_spans(tagger: Tagger, documents: list[str], batch: int = 256) -> list[list[Span]]:
    """All spans of each text: the base ones, and those that the tagger adds.

    Where a span reaches the edge of its window, the windows behind the edge are read too, one,
    then two, then four further on, until all spans end inside of what is read.
    """
    classes = [encode(d) if GATE.search(d) else np.zeros(0, np.int64) for d in documents]
    runs: list[dict[int, list]] = [{} for _ in documents]  # by window: kind, start, end, probability, open to the left, right
    where = [(i, int(s)) for i, c in enumerate(classes) for s in window_starts(c)]
    further = 1
    while where:
        for lo in range(0, len(where), batch):
            some = where[lo : lo + batch]
            tags, sure = tagger.decode(np.concatenate([cut(classes[i], np.array([s])) for i, s in some]))
            for (i, s), t, p in zip(some, tags, sure):
                n = len(documents[i])
                runs[i][s] = [
                    (KINDS[k], s + a, s + b, q, a == 0 and s > 0, b == WINDOW and s + WINDOW < n)
                    for k, a, b, q in spans_of_tags(t, p) if s + b <= n
                ]
        wanted = set()
        for i, s in where:
            for *_, left, right in runs[i][s]:
                steps = [-k for k in range(1, further + 1)] * left + list(range(1, further + 1)) * right
                wanted |= {(i, s + k * STRIDE) for k in steps if 0 <= s + k * STRIDE < len(documents[i])}
        where = sorted(w for w in wanted if w[1] not in runs[w[0]])
        further *= 2
    out = []
    for text, found in zip(documents, runs):
        spans = [(*s, True) for s in base_spans(text)] if text else []
        added = joined([r for s in sorted(found) for r in found[s]])
        if added:
            taken = _Taken((a, b) for _, a, b, _ in spans)
            for q, a, b, kind in sorted(set(added), key=lambda x: (-x[0], x[1], x[2], x[3])):
                if q >= SURE and plausible(kind, text[a:b]) and taken.add(a, b):
                    spans.append((kind, a, b, False))
        out.append(sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))
    return out


def joined(runs: list[tuple]) -> list[tuple[float, int, int, str]]:
    """Probability, start, end and kind of the runs that end inside of what was read.

    Parts of one kind that go on over an edge are joined where they meet in neighbouring
    windows, with the mean of their probabilities by length. A part that meets none is left to
    the window that holds its span whole.
    """
    out = [(q, a, b, kind) for kind, a, b, q, left, right in runs if not (left or right)]
    for kind in KINDS:
        parts = sorted((a, b, q, left, right) for k, a, b, q, left, right in runs if k == kind and (left or right))
        now = None
        for a, b, q, left, right in [*parts, (np.inf, np.inf, 0.0, False, False)]:
            if now and left and now[4] and a <= now[1]:
                weight, more = now[1] - now[0], b - a
                now = (now[0], max(now[1], b), (now[2] * weight + q * more) / (weight + more), now[3], right if b >= now[1] else now[4])
                continue
            if now and not (now[3] or now[4]):
                out.append((now[2], now[0], now[1], kind))
            now = (a, b, q, left, right)
    return out


class _Taken:
    """Disjoint intervals; ``add`` refuses one that overlaps."""

    def __init__(self, spans):
        self.cells: dict[int, list[tuple[int, int]]] = {}
        for a, b in spans:
            self._put(a, b)

    def _put(self, a, b):
        for cell in range(a // 64, (b - 1) // 64 + 1):
            self.cells.setdefault(cell, []).append((a, b))

    def add(self, a, b):
        if any(overlaps(a, b, self.cells.get(c, [])) for c in range(a // 64, (b - 1) // 64 + 1)):
            return False
        self._put(a, b)
        return True


def disguised(kind: str, part: str, rng) -> str:
    """A way in which people write such data that the base patterns miss."""
    if kind == "email":
        name, domain = part.split("@", 1)
        return [f"{name} @ {domain}", f"{name}@ {domain}", f"{name} @{domain}"][rng.integers(3)]
    if kind == "ip":
        return part.replace(".", [" . ", " ."][rng.integers(2)])
    if kind == "phone":
        return part.lstrip("+") if rng.integers(2) else part.replace("+", "00")
    digits = digits_of(part)
    return [".", "/", "_"][rng.integers(3)].join(digits[i : i + 4] for i in range(0, len(digits), 4))


def lengthened(part: str, rng) -> str:
    """An email address with more words in its name, of 30 to 150 characters, as some systems make them."""
    name, domain = part.split("@", 1)
    words = [w for w in re.split(r"[^A-Za-z0-9]+", part) if w]
    wanted = int(rng.integers(30, 150))
    while len(name) + len(domain) < wanted:
        name += "._-+"[rng.integers(4)] + words[rng.integers(len(words))]
    return f"{name}@{domain}"


def examples(documents: list[str], seed: int = 3, most: int = TRAIN_WINDOWS) -> tuple[np.ndarray, np.ndarray]:
    """Windows and tags from texts whose spans the base patterns label.

    The texts are drawn from again, with other windows and other rewrites, until there are
    ``most`` windows, so that few texts teach as long as many do.
    """
    rng = np.random.default_rng(seed)
    windows, tags = [], []
    for _ in range(DRAWS):
        for text in documents:
            _draw(text, rng, windows, tags)
            if len(windows) >= most:
                break
        if len(windows) >= most or not windows:
            break
    return np.array(windows[:most], np.int64).reshape(-1, WINDOW), np.array(tags[:most], np.int64).reshape(-1, WINDOW)


def _draw(text: str, rng, windows: list, tags: list) -> None:
    """Some windows of a text, in which about a third of the spans are rewritten, and some emails made longer."""
    spans = sorted((a, b, k) for k, a, b in base_spans(text))
    disjoint = [s for i, s in enumerate(spans) if not i or s[0] >= spans[i - 1][1]]
    out, labels, at = [], [], 0
    for a, b, kind in disjoint:
        out.append(text[at:a])
        part = text[a:b]
        if kind == "email" and rng.random() < 0.35:
            part = lengthened(part, rng)
        part = disguised(kind, part, rng) if rng.random() < 0.35 else part
        start = sum(map(len, out))
        labels.append((start, start + len(part), KINDS.index(kind)))
        out.append(part)
        at = b
    text = "".join([*out, text[at:]])
    classes, tag = encode(text), np.zeros(len(text) + WINDOW, np.int64)
    for a, b, k in labels:
        tag[a] = 2 * k + 1
        tag[a + 1 : b] = 2 * k + 2
    starts = window_starts(classes)
    # Windows that long spans go on in hold no digit or at sign, perhaps.
    inside = [s for a, b, _ in labels for s in range(a // STRIDE * STRIDE, b, STRIDE)]
    starts = np.unique(np.concatenate([starts, np.array(inside, np.int64)]))
    if len(starts) > 6:
        starts = rng.choice(starts, 6, replace=False)
    for s in starts:
        own = tag[s : s + WINDOW].copy()
        if own[0] and own[0] % 2 == 0:  # the window starts inside a span
            own[0] -= 1
        windows.append(cut(classes, np.array([s]))[0])
        tags.append(own)


def learn(docs: DataFrame, text_col: str = "text", most: int = TRAIN_TEXTS) -> Tagger:
    """A tagger trained on at most ``most`` texts with a digit or an at sign.

    Those with the least hashes, cut around what they hold to at most 4,000 characters each
    for training alone. Without such texts the tagger is untrained and adds nothing.
    """
    source = docs.select(text_of(text_col).alias("text"))
    total, share, rows = source.count(), 20.0 * most, []
    while len(rows) < most:  # a larger share of the hashes, until there are enough
        some = source.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(min(1.0, share / max(1, total)) * (1 << 30)))
        cut_out = some.where(F.col("text").rlike("[0-9@]")).select(
            F.expr("substring(text, greatest(1, regexp_instr(text, '[0-9@]') - 200), 4000)").alias("text"), F.xxhash64("text").alias("h"))
        rows = [r[0] for r in cut_out.distinct().orderBy("h", "text").limit(most).collect()]  # a bounded sample
        if share >= total:
            break
        share *= 10
    tagger = Tagger()
    windows, tags = examples(rows)
    if len(windows):
        tagger.train(windows, tags)
    else:
        tagger.p["o"][0] = 50.0
    return tagger


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def add_spans(docs: DataFrame, tagger: Tagger, text_col: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with a column of all spans, in code points, ends exclusive.

    Row by row over every whole text, without a shuffle; the tagger's few thousand numbers
    travel with the function. Base spans are always there; an added span overlaps none.
    Null and empty texts have none; rows with null ids and repeated rows are read as any. The
    column is the last one, and has underscores in front if the name is taken.
    """
    name = free_name(docs, name)
    out = docs.withColumn(name, F.expr(f"cast(array() as {SPANS})"))
    place, text_at = len(docs.columns), docs.columns.index(text_col)

    def run(batches):
        for piece in pieces(batches, 512):
            found = [[{"kind": k, "start": a, "end": b, "base": o} for k, a, b, o in s] for s in find_spans(tagger, texts(piece.column(text_at)))]
            yield pa.RecordBatch.from_arrays([*piece.columns[:place], pa.array(found, piece.schema.field(place).type)], schema=piece.schema)

    return out.mapInArrow(run, out.schema)


def redact(docs: DataFrame, tagger: Tagger, text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; a null text stays null.

    Where spans of different kinds overlap, the first one gives the mark and all their
    characters go. ``chars_col``, if given, is set to the new number of characters.
    """
    place = docs.columns.index(text_col)

    def run(batches):
        for piece in pieces(batches, 512):
            plain = piece.column(place).to_pylist()
            clean = [t if t is None else cover(t, s) for t, s in zip(plain, find_spans(tagger, [t or "" for t in plain]))]
            columns = list(piece.columns)
            columns[place] = pa.array(clean, piece.schema.field(place).type)
            yield pa.RecordBatch.from_arrays(columns, schema=piece.schema)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn(chars_col, F.char_length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col else out


def cover(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out.append(text[at:a])
            out.append(f"[{kind.upper()}]")
        at = max(at, b)
    return "".join([*out, text[at:]])
