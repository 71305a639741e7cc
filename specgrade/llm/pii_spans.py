"""Personal data: fixed patterns plus a semi-Markov conditional random field.

The patterns give the base spans.  The field looks at chunks, runs of digits
or of mail-address parts, cut into atoms.  Candidate segments are runs of at
most ``max_atoms`` atoms; whole-span features (digits, groups, separators,
checksum, cue word before) score each segment for each kind, and dynamic
programming over the chunk chooses boundaries and kinds jointly.  Outside of
chunks nothing can score, so leaving the rest out is exact.  Spans of the
field that overlap no base span are added to them: numbers without a plus
sign, addresses spelt with (at) and (dot).

Training uses the base spans of a bounded sample of chunks as gold labels,
and copies of the gold spans with the plus sign or the at sign respelt.

Defined results: null text counts as empty: no spans.  Positions are code
points, end exclusive.  Repeated rows each get their row; an empty table, or
one without digits and at signs, leaves the field untrained, which adds no
span.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrade.llm.common import whole_text

KINDS = ["email", "ip", "card", "phone"]
# Fixed values of the contract.  Possessive digits and the look-behind only
# keep long runs linear: a start inside a run of digits never does better.
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

NUMBERS = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*")
MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|[(\[]at[)\]]) ?[A-Za-z0-9-]+(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]+)*")
AT = re.compile(r"@|[(\[]at[)\]]")
ATOM = re.compile(r"[A-Za-z0-9]+")
CUES = {"phone": ("tel", "phone", "call", "fax", "mobile"), "card": ("card", "visa", "credit"), "ip": ("ip", "host", "address"), "email": ("mail", "contact")}
LEAST_DIGITS = 7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by the fixed patterns, sorted by start and kind."""
    out, at, free = [], text.find("@"), 0
    while at >= 0:
        head = text[free:at]
        start = free + len(head.rstrip(LOCAL))
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = only_digits(m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


@dataclass
class Chunk:
    """A stretch of text cut into atoms; ``before`` is the text before it."""

    text: str
    start: int
    before: str
    atoms: list[tuple[int, int]]


def chunks(text: str) -> list[Chunk]:
    out = []
    for pattern in (NUMBERS, MAIL):
        if pattern is MAIL and not AT.search(text):
            continue
        for m in pattern.finditer(text):
            found = m.group()
            if pattern is NUMBERS and sum("0" <= c <= "9" for c in found) < LEAST_DIGITS:
                continue
            atoms = [a.span() for a in ATOM.finditer(found)]
            if atoms:
                out.append(Chunk(found, m.start(), text[max(0, m.start() - 16):m.start()], atoms))
    return out


def segment(chunk: Chunk, i: int, j: int) -> tuple[int, int]:
    """Place in the chunk of atoms i to j - 1, with the sign or bracket that opens them."""
    a, b = chunk.atoms[i][0], chunk.atoms[j - 1][1]
    floor = chunk.atoms[i - 1][1] if i else 0
    while a > floor and chunk.text[a - 1] in "+(":
        a -= 1
    if b < len(chunk.text) and chunk.text[b] == ")" and "(" in chunk.text[a:b] and ")" not in chunk.text[a:b]:
        b += 1
    if "@" not in chunk.text[a:b] and j == len(chunk.atoms) and i == 0 and AT.search(chunk.text):
        a, b = 0, len(chunk.text)
    return a, b


def features(chunk: Chunk, i: int, j: int) -> list[str]:
    """Whole-span features of atoms i to j - 1."""
    a, b = segment(chunk, i, j)
    span = chunk.text[a:b]
    digits = only_digits(span)
    n = len(digits)
    groups = [chunk.text[x:y] for x, y in chunk.atoms[i:j]]
    numeric = all(g.isdigit() for g in groups)
    size = next(k for k in (0, 6, 7, 9, 11, 15, 16, 19, 10 ** 9) if n <= k)
    between = {c for c in span if not c.isalnum()}
    out = [f"digits{size}", f"groups{min(j - i, 6)}", "numeric" if numeric else "letters"]
    if numeric:
        out.append("apart:" + "".join(sorted(between & set(" .-()"))))
        if 12 <= n <= 19:
            out.append("luhn" if luhn(digits) else "not luhn")
        if len(groups) == 4 and between <= {"."}:
            out.append("bytes" if all(len(g) <= 3 and int(g) <= 255 for g in groups) else "not bytes")
        out.append("last" + str(min(len(groups[-1]), 5)))
        if span[:1] == "+":
            out.append("plus")
    else:
        ats = len(AT.findall(span))
        tail = AT.split(span)[-1]
        out.append(f"at{min(ats, 2)}")
        out.append("dot" if ats and (("." in tail) or "dot" in tail) else "no dot")
    out.append("whole" if (i, j) == (0, len(chunk.atoms)) else "part")
    if j < len(chunk.atoms):
        out.append("goes on")
    if i == 0 and chunk.before[-1:].isalnum():
        out.append("inside a word")
    low = chunk.before.lower()
    out += [f"cue {k}" for k, words in CUES.items() if i == 0 and any(w in low for w in words)]
    return out


LABELS = ["none", *KINDS]


class SemiCrf:
    """Weights of (kind, feature) and of (kind, next kind)."""

    def __init__(self, names: list[str] | None = None, max_atoms: int = 8):
        self.names = {f: k for k, f in enumerate(names or [])}
        self.w = np.zeros((len(LABELS), len(self.names)))
        self.moves = np.zeros((len(LABELS), len(LABELS)))
        self.max_atoms = max_atoms

    def lattice(self, chunk: Chunk) -> list[tuple[int, int, list[int]]]:
        """Candidate segments (i, j, features); every one is of bounded length."""
        n = len(chunk.atoms)
        return [(i, j, [self.names[f] for f in features(chunk, i, j) if f in self.names])
                for j in range(1, n + 1) for i in range(max(0, j - self.max_atoms), j)]

    def scores(self, lattice) -> np.ndarray:
        """Score of each segment for each label; ``none`` spans one atom."""
        out = np.stack([self.w[:, f].sum(axis=1) for _, _, f in lattice])
        out[[j - i > 1 for i, j, _ in lattice], 0] = -np.inf
        return out

    def best(self, chunk: Chunk) -> list[tuple[str, int, int]]:
        lattice, n = self.lattice(chunk), len(chunk.atoms)
        scores = self.scores(lattice)
        top = np.full((n + 1, len(LABELS)), -np.inf)
        back: dict[tuple[int, int], tuple[int, int]] = {}
        top[0, 0] = 0.0
        for (i, j, _), s in zip(lattice, scores):
            through = top[i][:, None] + (self.moves if i else np.where(np.arange(len(LABELS))[:, None] == 0, 0.0, -np.inf)) + s[None, :]
            prev = through.argmax(axis=0)
            value = through[prev, np.arange(len(LABELS))]
            for y in np.flatnonzero(value > top[j]):
                top[j, y], back[j, int(y)] = value[y], (i, int(prev[y]))
        j, y, out = n, int(top[n].argmax()), []
        while j:
            i, before = back[j, y]
            if y:
                a, b = segment(chunk, i, j)
                out.append((LABELS[y], chunk.start + a, chunk.start + b))
            j, y = i, before
        return out[::-1]

    def expected(self, lattice, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: probability of (segment, label) and of moves."""
        scores, k = self.scores(lattice), len(LABELS)
        first = np.where(np.arange(k)[:, None] == 0, 0.0, -np.inf) + np.zeros((k, k))
        alpha, beta = np.full((n + 1, k), -np.inf), np.full((n + 1, k), -np.inf)
        alpha[0, 0], beta[n] = 0.0, 0.0
        for (i, j, _), s in zip(lattice, scores):
            into = np.logaddexp.reduce(alpha[i][:, None] + (self.moves if i else first), axis=0) + s
            alpha[j] = np.logaddexp(alpha[j], into)
        for (i, j, _), s in sorted(zip(lattice, scores), key=lambda x: -x[0][0]):
            out = np.logaddexp.reduce((self.moves if i else first) + (s + beta[j])[None, :], axis=1)
            beta[i] = np.logaddexp(beta[i], out)
        log_z = np.logaddexp.reduce(alpha[n])
        seg, moves = np.zeros((len(lattice), k)), np.zeros((k, k))
        for at, ((i, j, _), s) in enumerate(zip(lattice, scores)):
            joint = np.exp(np.clip(alpha[i][:, None] + (self.moves if i else first) + (s + beta[j])[None, :] - log_z, -700, 0))
            seg[at] = joint.sum(axis=0)
            if i:
                moves += joint
        return seg, moves

    def fit(self, data: list[tuple[Chunk, list[tuple[str, int, int]]]], steps: int = 40, rate: float = 0.4, l2: float = 0.01, max_cases: int = 400) -> SemiCrf:
        """Gradient ascent (Adam); equal lattices with equal gold are one case with a
        weight, and the ``max_cases`` most frequent ones are learnt from."""
        cases: dict[tuple, list] = {}
        for chunk, gold in data:
            lattice = self.lattice(chunk)
            path, j = [], 0
            spans = {segment(chunk, i, e): (i, e) for i, e, _ in lattice}
            marked = {spans[a, b]: LABELS.index(kind) for kind, a, b in gold if (a, b) in spans}
            while j < len(chunk.atoms):
                hit = next(((i, e, y) for (i, e), y in marked.items() if i == j), (j, j + 1, 0))
                path.append(hit)
                j = hit[1]
            key = (tuple((i, e, tuple(f)) for i, e, f in lattice), tuple(path))
            cases.setdefault(key, [lattice, len(chunk.atoms), path, 0])[3] += 1
        kept = sorted(cases.items(), key=lambda c: (-c[1][3], c[0]))[:max_cases]
        m = v = np.zeros(self.w.size + self.moves.size)
        for t in range(1, steps + 1):
            g_w, g_m = -l2 * self.w, -l2 * self.moves
            for _, (lattice, n, path, times) in kept:
                weight = np.sqrt(times)
                seg, moves = self.expected(lattice, n)
                index = {(i, e): at for at, (i, e, _) in enumerate(lattice)}
                target = np.zeros_like(seg)
                for i, e, y in path:
                    target[index[i, e], y] = 1
                for (_, _, f), d in zip(lattice, target - seg):
                    g_w[:, f] += weight * d[:, None]
                for (_, _, a), (_, _, b) in zip(path, path[1:]):
                    g_m[a, b] += weight
                g_m -= weight * moves
            g = np.concatenate([g_w.ravel(), g_m.ravel()]) / max(1, len(kept))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
            self.w, self.moves = self.w + step[:self.w.size].reshape(self.w.shape), self.moves + step[self.w.size:].reshape(self.moves.shape)
        return self


def respelt(chunk: Chunk, gold: list[tuple[str, int, int]]):
    """Copies of a chunk that is one gold span, spelt without the plus or at sign."""
    if len(gold) != 1 or gold[0][1:] != (0, len(chunk.text)):
        return
    kind, text = gold[0][0], chunk.text
    if kind == "phone" and text[0] == "+":
        variants = [text[1:].lstrip()]
    elif kind == "email":
        head, _, tail = text.partition("@")
        variants = [f"{head} (at) {tail}", f"{head} [at] {tail.replace('.', ' [dot] ')}", f"{head}(at){tail.replace('.', ' (dot) ')}"]
    else:
        return
    for t in variants:
        yield Chunk(t, 0, chunk.before, [a.span() for a in ATOM.finditer(t)]), [(kind, 0, len(t))]


def learn(docs: DataFrame, train_docs: int = 4000, max_chunks: int = 8000, max_cases: int = 400, max_chars: int = 200) -> SemiCrf:
    """Fit on the chunks of a sample: about ``train_docs`` rows by the hash of
    their text, and of their chunks the ``max_chunks`` of smallest hash.
    Chunks of more than ``max_chars`` characters are not learnt from, and of the
    distinct cases the ``max_cases`` most frequent are."""
    rows = max(1, docs.count())
    rate = min(1_000_000, 1 + train_docs * 1_000_000 // rows)
    sample = docs.select(whole_text().alias("text")).filter((F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < rate) & F.col("text").rlike("[0-9@]"))

    def found(batches):
        for pdf in batches:
            out = [(c.before, c.text, t[c.start + len(c.text):c.start + len(c.text) + 8]) for t in pdf["text"] for c in chunks(t) if len(c.text) <= max_chars]
            yield pd.DataFrame(out, columns=["before", "chunk", "after"])

    got = (sample.mapInPandas(found, "before string, chunk string, after string")
           .orderBy(F.xxhash64("before", "chunk"), "before", "chunk", "after").limit(max_chunks).toPandas())
    data = []
    for before, text, after in got.itertuples(index=False):
        chunk = Chunk(text, 0, before, [a.span() for a in ATOM.finditer(text)])
        here = len(before)
        gold = [(k, a - here, b - here) for k, a, b in base_spans(before + text + after) if a >= here and b <= here + len(text)]
        gold = [g for k, g in enumerate(gold) if all(g[1] >= h[2] for h in gold[:k])]
        data += [(chunk, gold), *respelt(chunk, gold)]
    names = sorted({f for c, _ in data for i in range(len(c.atoms)) for j in range(i + 1, min(len(c.atoms), i + 8) + 1) for f in features(c, i, j)})
    return SemiCrf(names).fit(data, max_cases=max_cases) if data else SemiCrf()


def all_spans(text: str, model: SemiCrf) -> tuple[list, list]:
    """(base spans, spans the field adds), both sorted."""
    if not text or not (AT.search(text) or re.search("[0-9]", text)):
        return [], []
    base = base_spans(text)
    if not model.names:
        return base, []
    added = []
    for chunk in chunks(text):
        for kind, a, b in model.best(chunk):
            if all(b <= s or a >= e for _, s, e in base + added):
                added.append((kind, a, b))
    return base, added


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def pii_spans(docs: DataFrame, model: SemiCrf) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone
    (base spans), n_added, base_sha256, spans."""
    def scan(batches):
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                base, added = all_spans(text, model)
                kinds = [k for k, _, _ in base]
                out.append((doc_id, *(kinds.count(k) for k in KINDS), len(added), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added)))
            got = pd.DataFrame(out, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "n_added", "base_sha256", "spans"])
            yield got.astype({"doc_id": "Int64"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInPandas(scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_added long, base_sha256 string, spans string")
