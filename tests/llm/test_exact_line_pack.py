"""Exact dedup, line dedup, packing, token counts and url filters against brute force, with edge cases."""

import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from specgrade.llm.exact_dedup import exact_dedup
from specgrade.llm.line_dedup import line_dedup
from specgrade.llm.encoding import byte_bpe
from specgrade.llm.packing import pack
from specgrade.llm.packing_plan import plan, reduce_dominated
from specgrade.llm.token_counts import CountedText, masking_edits, token_counts
from specgrade.llm.url_filter import url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, hash string, n long"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANK = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None, "x", "y", 1) for i, t in rows], SCHEMA)


EDGES = [(10, "a <|endoftext|> b"), (1, None), (2, ""), (3, "A b"), (4, "a B"), (4, "a B"), (None, "a b"), (5, "Ä"), (6, "ä"), (7, "word " * 30000), (8, "x\n\nX \n y"), (9, "x")]


def test_exact_dedup(spark):
    got = exact_dedup(table(spark, EDGES), counters=2).collect()
    groups = {}
    for i, t in EDGES:
        groups.setdefault((t or "").translate(AZ), []).append(i)
    assert len(got) == len(EDGES) and sum(r.kept for r in got) == len(groups)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == max(i for i in ids if i is not None)
    assert exact_dedup(table(spark, [])).count() == 0


@pytest.mark.parametrize("batches,fanout", [(1, 2), (5, 2), (4, 4)])
def test_line_dedup(spark, batches, fanout):
    rows = EDGES + [(100 + i, f"Common line \nown {i}\n common LINE\n\nlast") for i in range(12)]
    got = line_dedup(table(spark, rows), batches=batches, fanout=fanout, hot=2).collect()
    key = lambda line: line.strip(BLANK).translate(AZ)
    held = {}
    for _, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            held[k] = held.get(k, 0) + 1
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if held.get(key(x), 0) < 10]
        want.append((str(i), "\n".join(kept), len(lines), len(lines) - len(kept)))
    assert sorted((str(r.doc_id), r.text, r["__n_lines"], r["__n_dropped"]) for r in got) == sorted(want)
    assert line_dedup(table(spark, [])).count() == 0


def _optimum(lengths, size):
    best = len(lengths)

    def place(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= rest[0]:
                place(rest[1:], rooms[:k] + (rooms[k] - rest[0],) + rooms[k + 1:])
        place(rest[1:], rooms + (size - rest[0],))
    place(tuple(sorted(lengths, reverse=True)), ())
    return best


def test_reduction_keeps_the_optimum():
    rng = np.random.default_rng(3)
    for _ in range(150):
        lengths = rng.integers(1, 21, rng.integers(1, 9)).tolist()
        counts = {x: lengths.count(x) for x in set(lengths)}
        fixed, rest = reduce_dominated(dict(counts), 20)
        left = list(itertools.chain.from_iterable([x] * k for x, k in rest.items()))
        assert all(sum(p.lengths) <= 20 for p in fixed)
        assert sum(p.times for p in fixed) + _optimum(left, 20) == _optimum(lengths, 20)
        every = plan(dict(counts), 20)
        assert sorted(itertools.chain.from_iterable(list(p.lengths) * p.times for p in every)) == sorted(lengths)


def test_pack(spark):
    rows = EDGES + [(50 + i, "tok " * (i * 37 % 300)) for i in range(60)]
    got = pack(table(spark, rows), size=64, rows_per_group=7, with_ids=True).toPandas()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((str(i), tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    whole = {}
    for r in got.itertuples():
        assert r.length == len(r.ids) <= 64 and r.ids_crc32 == zlib.crc32(np.asarray(r.ids, dtype="<u4").tobytes())
        assert r.piece == 0 or r.length == 64
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset.to_numpy() == np.concatenate(([0], g.length.cumsum()[:-1]))).all() and g.length.sum() <= 64
    once = got[~got.doc_id.isin([4]) & got.doc_id.notna()]
    for i, g in once.groupby("doc_id"):
        whole[str(int(i))] = tuple(itertools.chain.from_iterable(g.sort_values("piece").ids))
        assert g.sort_values("piece").start.tolist() == np.concatenate(([0], g.sort_values("piece").length.cumsum()[:-1])).tolist()
    assert whole == {i: t for i, t in want if i not in ("4", "None")}
    assert got.sequence_id.nunique() <= 1.05 * -(-got.length.sum() // 64) + 1
    assert pack(table(spark, [])).count() == 0


def test_same_ids_as_tokenizers(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["<|endoftext|> a", "a\u00a0b \u3000 c", "\t\r\n x  y", "日本語 ١٢٣ ½", "it's we'll", "\x1c\x85 z"]
    encode = byte_bpe()
    for t, e in zip(texts + odd, tok.encode_batch(texts + odd, add_special_tokens=False)):
        assert encode(t) == e.ids


def test_edits_count_like_encoding_anew():
    encode, rng = byte_bpe(), np.random.default_rng(5)
    count = lambda s: len(encode(s))
    words = ["<|endoftext|>", "alpha", "beta,", "12 34", "it's", "  ", "\n", "Ünï", "x" * 40, "###"]
    for size in (1, 8, 64):
        doc = CountedText(" ".join(rng.choice(words, 200)), count, size)
        for _ in range(60):
            a = int(rng.integers(0, len(doc.text) + 1))
            b = min(len(doc.text), a + int(rng.integers(0, 30)))
            doc.edit(a, b, "".join(rng.choice([*words, "", " "], int(rng.integers(0, 3)))))
            assert doc.tree.tokens == count(doc.text) and doc.tree.sums[1, 0] == len(doc.text)
    empty = CountedText("", count)
    empty.edit(0, 0, "new text")
    assert empty.tree.tokens == count("new text")


def test_masking_edits_as_one_pattern():
    both, rng = re.compile(r"[^\s@]+@[^\s@]+|[0-9][0-9 ().-]{5,}[0-9]"), np.random.default_rng(6)
    odd = ["", "@", "a@", "@b", "a@b@c", "a@b@c@d", "12 34567x@y", "1234567@x", "a@1234567 8", "x@y 12 (34) 56-78 z@w", "1234567x@y@z", "a@@b", "12345678 9@a@b"]
    odd += ["".join(rng.choice(list("a1 @.-("), 40)) for _ in range(3000)]
    for text in odd:
        assert masking_edits(text) == [(m.start(), m.end(), "[mail]" if "@" in m.group() else "[number]") for m in both.finditer(text)], text
    start = time.monotonic()
    assert masking_edits("a" * 1_000_000 + "1") == [] and len(masking_edits(("b" * 500_000 + "@") * 2 + "c")) == 1
    assert time.monotonic() - start < 10


def test_token_counts_of_a_table(spark):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda s: len(tok.encode(s, add_special_tokens=False).ids)
    rows = EDGES + [(60, "mail a@b.c or 0123 456 789 now"), (61, "x" * 200_000 + "1"), (None, None)]
    got = token_counts(table(spark, rows)).collect()
    want = []
    for i, t in rows:
        edits, after = masking_edits(t or ""), t or ""
        for a, b, new in reversed(edits):
            after = after[:a] + new + after[b:]
        want.append((str(i), count(t or ""), len(edits), count(after), len(after)))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_edits, r.n_tokens_after, r.n_chars_after) for r in got) == sorted(want)
    assert token_counts(table(spark, [])).count() == 0


def test_url_filter(spark):
    rules = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    urls = [None, "", "nourl", "http://", "HTTP://WWW.Example.COM/en/x", "http://a.example.com/en/1?x=1", "http://example.com/en", "http://badexample.com/en/", "x://q.net/es/?a", "x://net#f", "x://net/fr/", "http://é.org/ü", "x://a?b/en/"]
    urls += [f"http://h{i}.example.{'com' if i % 2 else 'net'}/{'es' if i % 4 else 'de'}/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, 0.5, "z") for i, u in enumerate(urls)] + [(None, urls[4], 0.1, "z")], "page_id long, url string, score double, host string")
    got = url_filter(pages, trees=2, train_rows=40).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = urls[4] if r.page_id is None else urls[r.page_id]
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group().translate(AZ)
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        fit = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fit)[1] if fit else None)
        assert r.verdict == max(fit)[2] if fit else r.verdict in ("allow", "block")
    assert url_filter(pages.filter("page_id < 3")).filter("verdict <> 'allow'").count() == 0
    assert url_filter(pages.limit(0)).count() == 0
