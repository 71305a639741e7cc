"""Collocations, mixture packing and token alignment against brute force."""

import collections
import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from specgrade.llm.collocations import collocations, misra_gries
from specgrade.llm.encoding import byte_bpe
from specgrade.llm.mixture_packing import mixture
from specgrade.llm.mixture_plan import plan, sent
from specgrade.llm.token_alignment import alignment
from specgrade.plans.compare import duck_connection
from tests.conftest import SF01

SCHEMA = "doc_id long, text string, lang string, source string, n long, score double, part int, queue int, digest string, w string"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "a", "<|endoftext|>", "x <|endoftext|> y", "a\x00b\x1cc\x85d\xa0e f", "▁ ▁▁", "ﬁ é é 日本語 🙂", " \n\t  \r\n", "\x0b\x0c..;;", "word " * 30000]


def table(spark, rows):
    """Rows of (doc_id, text, lang, source), with columns that clash."""
    return spark.createDataFrame([(*r, 1, 0.5, 7, 9, "d", "w") for r in rows], SCHEMA)


# --- collocations

def plain_collocations(rows, top, min_count, longest, num, den):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i:i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    f = {k: c for k, c in f.items() if c >= min_count}
    out = collections.defaultdict(list)
    for (lang, *w), a in f.items():
        if len(w) < 2:
            continue
        score, k = min((2000000 * a // (f[(lang, *w[:k])] + f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        if any(len(v) - 1 > len(w) and v[0] == lang and den * c >= num * a and any(list(v[1 + i:1 + i + len(w)]) == w for i in range(len(v) - len(w)))
               for v, c in f.items()):
            continue
        out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, rank, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1))


@pytest.mark.parametrize("top,min_count,longest,mass", [(2000, 3, 4, 1 << 22), (3, 2, 3, 50), (2000, 5, 2, 50)])
def test_collocations(spark, top, min_count, longest, mass):
    rng = np.random.default_rng(7)
    words = ["New", "york", "CITY", "of", "the", "a\x1cb", "é", "日本", "x\xa0y", "z"]
    rows = [(i, t, None, None) for i, t in enumerate(ODD[:-1])]
    for i in range(120):
        w = [str(x) for x in rng.choice(words, rng.integers(1, 30), p=[.2, .2, .1, .1, .1, .06, .06, .06, .06, .06])]
        text = "".join(x + str(s) for x, s in zip(w, rng.choice([" ", "\t ", ". ", ",", "\n", "  "], len(w), p=[.6, .1, .1, .05, .05, .1])))
        rows.append((i, text, [None, "en", "", "de"][i % 4], "s"))
    rows += [(7, "New York city of the z", "en", None)] * 20  # repeated rows
    got = collocations(table(spark, rows), top=top, min_count=min_count, longest=longest, mass=mass, filter_bits=12)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, top, min_count, longest, 80, 100)


def test_exact_counts_are_added_up_in_a_task(monkeypatch):
    """A task sends each phrase once, not once a stretch of text, in order."""
    import zlib
    from types import SimpleNamespace

    import pyarrow as pa

    from specgrade.llm import collocations as made
    monkeypatch.setattr(made, "CHUNK_BYTES", 8)
    texts = ["a b a b.", "a b c", "", "b c"] * 5
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"] * len(texts), "text": texts}) for _ in range(3)]
    maps = SimpleNamespace(value=[zlib.compress(b"\xff" * 8)] * 2)
    got = [(r["key"], r["f"]) for b in made._exact(6, 2, maps)(iter(batches)) for r in b.to_pylist()]
    assert got == sorted({"2:en": 135, "2:ena": 45, "2:enb": 60, "2:enc": 30, "2:ena b": 45, "2:enb a": 15, "2:enb c": 30}.items())
    counts = [pa.RecordBatch.from_pydict({"key": [f"k{i}", "same"], "f": [i, 1]}) for i in range(40)]
    sent = [(r["key"], r["f"]) for b in made.added_up(iter(counts), 16, 1 << 20) for r in b.to_pylist()]
    assert sum(f for k, f in sent if k == "same") == 40 and len(sent) < 60
    assert sorted(x for x in sent if x[0] != "same") == sorted((f"k{i}", i) for i in range(40))


def test_a_frequent_phrase_stays_in_its_task():
    """What is too much to hold goes out, but not the phrases that return."""
    import pyarrow as pa

    from specgrade.llm.collocations import added_up
    counts = [{"key": [f"k{i:04}", "same", "x" * (i % 7)], "f": [1, 2, 1]} for i in range(400)]
    want = collections.Counter()
    for c in counts:
        want.update(dict(zip(c["key"], c["f"])))
    for rows, size in ((32, 1 << 20), (1 << 20, 2000)):
        got = collections.Counter()
        sent = [(r["key"], r["f"]) for b in added_up((pa.RecordBatch.from_pydict(c) for c in counts), rows, size) for r in b.to_pylist()]
        for k, f in sent:
            got[k] += f
        assert got == want
        assert sum(k == "same" for k, _ in sent) == 1
    # a phrase longer than what may be held still goes through
    long = [pa.RecordBatch.from_pydict({"key": ["y" * 5000, "same"], "f": [9, 1]}) for _ in range(3)]
    assert sum(r["f"] for b in added_up(iter(long), 32, 2000) for r in b.to_pylist()) == 30


def test_rows_follow_the_phrases_not_the_splits(spark, monkeypatch):
    """The exact pass sends a phrase once a task, and splits make no tasks."""
    from specgrade.llm import collocations as made
    sent, exact = spark.sparkContext.accumulator(0), made._exact

    def seen(*args):
        run = exact(*args)

        def counted(batches):
            for b in run(batches):
                sent.add(len(b))
                yield b
        return counted

    monkeypatch.setattr(made, "_exact", seen)
    monkeypatch.setattr(made, "TASKS_PER_CORE", 1, raising=False)
    cores = spark.sparkContext.defaultParallelism
    rows = [(i, f"alpha beta gamma delta {i % 2}", "en", None) for i in range(24 * cores)]
    docs = table(spark, rows).repartition(12 * cores, "doc_id")
    got = collocations(docs, min_count=4, filter_bits=20)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 2000, 4, 4, 80, 100)
    phrases = {(lang, *w[i:i + m]) for _, t, lang, _ in rows for w in [t.split()] for m in range(1, 5) for i in range(len(w) - m + 1)}
    assert 0 < sent.value <= cores * (len(phrases) + 1)


def test_collocations_full_filter_and_empty(spark):
    """A bitmap that lets nearly all through changes nothing; no rows, no words."""
    rows = [(i, f"alpha beta {i} gamma delta {i % 3}", "en", None) for i in range(40)]
    want = plain_collocations(rows, 2000, 4, 4, 80, 100)
    got = collocations(table(spark, rows), min_count=4, filter_bits=6)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert collocations(table(spark, [])).count() == 0
    assert collocations(table(spark, [(1, None, None, None), (2, "", "en", "s"), (3, "...", "en", "s")])).count() == 0


def test_misra_gries_keeps_what_is_frequent():
    rng = np.random.default_rng(1)
    items = np.sort(rng.zipf(1.3, 20000) % 5000).astype(np.uint64)
    for threshold in (5, 50, 500):
        capacity = len(items) // threshold + 1
        held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        for part in np.array_split(rng.permutation(items), 40):
            k, n = np.unique(np.concatenate([np.repeat(*held), part]), return_counts=True)
            held = misra_gries(k, n, capacity)
            assert len(held[0]) <= capacity
        keys, counts = np.unique(items, return_counts=True)
        low = dict(zip(held[0].tolist(), held[1].tolist()))
        for k, c in zip(keys.tolist(), counts.tolist()):
            assert c < threshold or c - threshold < low.get(k, 0) <= c


# --- mixture packing

def default_ids(text, end, plain=False):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = plain
    return t.encode(text or "", add_special_tokens=False).ids + end


def round_robin(tokens, weights, size):
    """The same windows, one after the other, with deficits as fractions."""
    left, windows, active = list(tokens), [], list(range(len(tokens)))
    while active:
        total = sum(weights[s] for s in active)
        n = min(left[s] * total // (weights[s] * size) for s in active)
        deficit = dict.fromkeys(active, Fraction(0))
        for _ in range(n):
            give = dict.fromkeys(active, 0)
            for s in active:
                deficit[s] += Fraction(weights[s] * size, total)
                give[s] = int(deficit[s])
            missing = size - sum(give.values())
            for s in sorted(active, key=lambda s: (-(deficit[s] - give[s]), s))[:missing]:
                give[s] += 1
            for s in active:
                deficit[s] -= give[s]
                left[s] -= give[s]
            windows.append([give.get(s, 0) for s in range(len(tokens))])
        active = [s for s in active if left[s] * total // (weights[s] * size)]
    return windows, left


@pytest.mark.parametrize("seed", range(12))
def test_closed_form_is_round_robin(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.choice([8, 16, 64]))
    tokens = [int(x) for x in rng.integers(1, 3000, rng.integers(1, 6))]
    weights = tokens if seed % 2 == 0 and min(tokens) * size >= sum(tokens) else [int(x) for x in rng.integers(10, 40, len(tokens))]
    p = plan(tokens, weights, size)
    windows, left = round_robin(tokens, weights, size)
    got = [row for ph in p.phases for row in np.diff(sent(ph, size, 0, ph.windows), axis=1).T.tolist()]
    assert got == windows and [t - x for t, x in zip(tokens, p.left)] == left
    steps = np.diff((0, *p.tail)).tolist()
    assert sum(steps) == sum(left) and all(s == size or s & (s - 1) == 0 for s in steps)


def check_packing(rows, got, size, end):
    ids = [default_ids(t, [end]) for _, t, _, _ in rows]
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_doc[(r.doc_id, r.doc_tokens)].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    want = collections.Counter()
    for (i, *_), x in zip(rows, ids):
        want[(i, tuple(x))] += 1
    have = collections.Counter()
    for (i, n), found in by_doc.items():
        starts = collections.defaultdict(list)
        for r in found:
            starts[r.start].append(r)
            assert r.ids is None or zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        # rows with one doc_id and number of tokens hold the same text here
        while any(starts.values()):
            at, whole = 0, []
            while at < n:
                r = starts[at].pop()
                whole += r.ids
                at += r.length
            have[(i, tuple(whole))] += 1
    assert have == want
    padding = 0
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def odd_rows():
    rows = [(i, t, "en", [None, "", "hot"][i % 3]) for i, t in enumerate(ODD)]
    rows += [(100 + i, f"text {i} " * (i % 50), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(150)]
    return rows + [(None, "no id", None, "hot")]


@pytest.mark.parametrize("max_queues,broadcast_rows,targets", [(64, 200_000, None), (4, 0, None), (64, 200_000, {"hot": 0.5, "s1": 0.25})])
def test_mixture_round_trip(spark, max_queues, broadcast_rows, targets):
    rows = odd_rows()
    got = mixture(table(spark, rows).repartition(5), size=256, max_queues=max_queues, broadcast_rows=broadcast_rows, targets=targets, with_ids=True).collect()
    assert check_packing(rows, got, 256, 1) == 0


def test_mixture_shares_in_every_window(spark):
    rows = [(i, "one two three " * (1 + i % 40), "en", "abc"[(i % 7) % 3]) for i in range(400)]
    got = mixture(table(spark, rows).repartition(4), size=128).collect()
    total = collections.Counter()
    for r in got:
        total[r.source] += r.length
    windows = collections.defaultdict(collections.Counter)
    for r in got:
        windows[r.sequence_id][r.source] += r.length
    whole = sum(total.values()) // 128
    run = collections.Counter()
    for w in range(whole):
        run.update(windows[w])
        assert sum(windows[w].values()) == 128
        for s, n in total.items():
            assert abs(Fraction(n * 128 * (w + 1), sum(total.values())) - run[s]) < 1
    assert mixture(table(spark, [])).count() == 0


def test_mixture_many_sources_share_a_queue(spark):
    """More sources than queues, one of a third of all rows: nothing lost."""
    rows = [(i, "lorem ipsum " * (i % 9), None, "hot" if i % 3 == 0 else f"source {i}") for i in range(300)]
    got = mixture(table(spark, rows).repartition(3), size=64, max_queues=5, with_ids=True).collect()
    assert check_packing(rows, got, 64, 1) == 0


def test_ids_are_those_of_the_default_tokenizer():
    encode, plain = byte_bpe(), byte_bpe(special=False)
    for text in [t for t in ODD if t] + ["<|endoftext|><|endoftext|>", "a" * 300_000, " " * 400_000 + "x", ("\n" * 150_000) + "a  b", "<|endoftext|>" + " " * 250_000]:
        assert encode(text) == default_ids(text, []) and plain(text) == default_ids(text, [], True)


# --- token alignment

def plain_alignment(rows):
    a_tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    from tokenizers.pre_tokenizers import ByteLevel
    # the byte-level alphabet: bytes that print stand for themselves, the others follow in order
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    signs = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    assert set(signs) == set(ByteLevel.alphabet())

    def b_bytes(i):
        piece = b_tok.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()
    done = {}
    for _, text, _, _ in rows:
        text = text or ""
        if text in done:
            continue
        a = a_tok.encode(" " + text, add_special_tokens=False).ids
        b = b_tok.encode(text)
        xa = [bytes(signs[c] for c in a_tok.id_to_token(i)) for i in a]
        xb = [b_bytes(i) for i in b]
        if not text or b"".join(xa) != (" " + text).encode() or b"".join(xb) != (" " + text).encode():
            done[text] = ([], [], [], [])
            continue
        ea, eb = np.cumsum([len(x) for x in xa]).tolist(), np.cumsum([len(x) for x in xb]).tolist()
        at_a, at_b = collections.defaultdict(list), collections.defaultdict(list)
        for i, e in zip(a, ea):
            at_a[e].append(i)
        for i, e in zip(b, eb):
            at_b[e].append(i)
        links = [(i, j) for e in at_a for i in at_a[e] for j in at_b.get(e, ())]
        groups, p = [], 0
        for e in sorted(set(ea) & set(eb)):
            groups.append(",".join(str(i) for i, x in zip(a, ea) if p < x <= e) + "|" + ",".join(str(i) for i, x in zip(b, eb) if p < x <= e))
            p = e
        done[text] = (a, b, groups, links)
    counts = collections.Counter(link for _, t, _, _ in rows for link in done[t or ""][3])
    best = collections.Counter()
    for (_, j), c in counts.items():
        best[j] = max(best[j], c)
    out = []
    for i, t, _, _ in rows:
        a, b, groups, links = done[t or ""]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=str)


@pytest.mark.parametrize("heavy", [1, 4, 1024])
def test_alignment(spark, heavy):
    rows = [(i, t, None, None) for i, t in enumerate(ODD[:-1])] + [(50, "word " * 3000, None, None)]
    con = duck_connection(SF01)
    rows += [(1000 + i, t, None, None) for i, t in con.sql("SELECT doc_id, left(text, 600) FROM documents WHERE doc_id < 60").fetchall()]
    rows += [(2000 + i % 9, "One text held by a third of the rows, naïve <s> </s> <unk> <0x41> ▁.", None, None) for i in range(40)]
    got = alignment(table(spark, rows), heavy=heavy).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_alignment(rows)
    assert alignment(table(spark, [])).count() == 0
