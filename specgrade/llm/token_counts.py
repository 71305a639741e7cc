"""Edit-aware token counts.

A document is cut into leaves of about ``leaf_chars`` characters at places
where no pre-token can span: a single space between two characters that are
not blanks.  So the tokens of the document are the tokens of its leaves.  A
segment tree holds the sums of characters and tokens below every node.  An
edit (start, end, replacement) finds its leaves by descending the tree; the
touched region grows leaf by leaf while its borders are no safe cuts in the
new text, only that region is encoded again, and the sums above it are
updated.

Defined results: null text counts as empty and has no tokens.  Edits are in
the coordinates of the text they apply to, sorted and not overlapping.  A text
without safe cuts is one leaf, which is always right, only slower.  Repeated
rows each get their row; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgrade.llm.common import whole_text
from specgrade.llm.encoding import VOCABULARY, byte_bpe

SAFE = re.compile(r"(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")


def leaves(text: str, leaf_chars: int) -> list[str]:
    """The text in leaves; each but the first begins at a safe cut."""
    out, at = [], 0
    while at < len(text):
        m = SAFE.search(text, at + leaf_chars)
        end = m.start() if m else len(text)
        out.append(text[at:end])
        at = end
    return out


class SegmentTree:
    """Sums of characters and tokens over the leaves of a document, as two
    arrays in heap order: node k has the children 2k and 2k + 1."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.width = 1 << max(0, (len(chars) - 1).bit_length())
        self.sums = np.zeros((2 * self.width, 2), dtype=np.int64)
        self.sums[self.width:self.width + len(chars), 0] = chars
        self.sums[self.width:self.width + len(tokens), 1] = tokens
        for k in range(self.width - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds the character, and where that leaf starts; the
        last leaf with text for a place at the end."""
        k, start = 1, 0
        char = min(char, max(0, int(self.sums[1, 0]) - 1))
        while k < self.width:
            k *= 2
            if char - start >= self.sums[k, 0]:
                start += int(self.sums[k, 0])
                k += 1
        return k - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.width
        change = np.array([chars, tokens]) - self.sums[k]
        while k:
            self.sums[k] += change
            k //= 2


class CountedText:
    """A text with its tree; ``encoded`` counts the characters encoded since it was built."""

    def __init__(self, text: str, count, leaf_chars: int = 256):
        self.text, self.count, self.encoded = text, count, 0
        parts = leaves(text, leaf_chars) or [""]
        self.tree = SegmentTree([len(p) for p in parts], [count(p) for p in parts])

    def edit(self, start: int, end: int, new: str) -> None:
        before = self.text
        self.text = before[:start] + new + before[end:]
        tree, grown = self.tree, len(new) - (end - start)
        low, low_start = tree.find(start)
        high, high_start = tree.find(max(start, end - 1))
        high_end = high_start + int(tree.sums[tree.width + high, 0])
        # boundary context: both borders must be safe cuts of the new text
        while low_start > 0 and not self._safe(low_start):
            low, low_start = tree.find(low_start - 1)
        while high_end < len(before) and not self._safe(high_end + grown):
            high, _ = tree.find(high_end)
            high_end += int(tree.sums[tree.width + high, 0])
        region = self.text[low_start:high_end + grown]
        self.encoded += len(region)
        for leaf in range(low + 1, high + 1):
            tree.put(leaf, 0, 0)
        tree.put(low, len(region), self.count(region))

    def _safe(self, at: int) -> bool:
        return SAFE.match(self.text, at) is not None


NUMBER = re.compile(r"[0-9][0-9 ().-]{5,}[0-9]")


def mail_places(text: str) -> list[tuple[int, int]]:
    """Runs without blanks and at signs on both sides of an at sign, found
    from the at signs outwards."""
    out, before, at = [], -1, None
    ends = [m.start() for m in re.finditer(r"[\s@]", text)] + [len(text)] if "@" in text else []
    for end in ends:
        if at is not None and end > at + 1:
            out.append((at, end, start))
        at, start = (end, before + 1) if end < len(text) and text[end] == "@" and end > before + 1 else (None, None)
        before = end
    return [(start, end) for _, end, start in out]


def masking_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits of a clean-up pass: mail addresses and long numbers are masked,
    the leftmost first, a mail address before a number."""
    out, at, mails = [], 0, iter(mail_places(text))
    mail, number = next(mails, None), NUMBER.search(text)
    while mail or number:
        # what an earlier edit took is no longer there to match
        if mail and mail[0] < at:
            sign = text.index("@", mail[0])
            mail = (at, mail[1]) if at < sign else next(mails, None)
        elif number and number.start() < at:
            number = NUMBER.search(text, at)
        elif mail and (not number or mail[0] <= number.start()):
            out.append((*mail, "[mail]"))
            at, mail = mail[1], next(mails, None)
        else:
            out.append((number.start(), number.end(), "[number]"))
            at, number = number.end(), NUMBER.search(text, number.end())
    return out


def token_counts(docs: DataFrame, edits=masking_edits, vocabulary: str = VOCABULARY, leaf_chars: int = 256) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_edits, n_tokens_after,
    n_chars_after, reencoded_chars; ``edits`` gives the edits of a text."""
    def run(batches):
        encode = byte_bpe(vocabulary)
        count = lambda s: len(encode(s))
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                doc = CountedText(text, count, leaf_chars)
                n, found = doc.tree.tokens, edits(text)
                for start, end, new in reversed(found):  # from the back, so that places stay right
                    doc.edit(start, end, new)
                out.append((doc_id, n, len(found), doc.tree.tokens, len(doc.text), doc.encoded))
            got = pd.DataFrame(out, columns=["doc_id", "n_tokens", "n_edits", "n_tokens_after", "n_chars_after", "reencoded_chars"])
            yield got.astype({"doc_id": "Int64"})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_chars_after long, reencoded_chars long")
