"""Edit-aware token counts: a segment tree of token counts per document.

A text is cut into segments of about ``SEGMENT`` characters at places where no pre-token can span
the cut whatever lies beyond its neighbours: between a character that is not white space and a space
followed by one that is not. Leaves hold the segments' token counts, inner nodes the sums. An edit
re-encodes the segments it touches; where it changes the characters around a cut, the neighbour on
that side is taken along as boundary context until the region ends at safe cuts. New counts go into
the touched leaves and up their paths. A region beyond ``LARGE`` segments is cut anew and the tree rebuilt
around it, the other leaves with their counts. ``tree_column`` gives trees to be stored, and
``edited_column`` applies later edits to stored trees.

Edge cases: a null text is empty; a null list of edits is none; edits apply in order, each to the
text that the earlier ones left; their places are clamped to the text; an edit with a null text
deletes. A very long text without safe cuts (no single spaces) is one segment, which each edit encodes
again. There are no ties; an empty table gives no row. Repeated rows are counted each. Extra columns pass through;
one of the result's own name is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import TOKENIZER, Encoder, encoder

SEGMENT = 512
LARGE = 8
_WHITE = frozenset(chr(c) for c in range(0x3001) if chr(c).isspace())


def safe_cut(text: str, at: int) -> bool:
    """Whether a pre-token border lies before ``at`` by the three characters around it alone."""
    return 0 < at < len(text) - 1 and text[at] == " " and text[at - 1] not in _WHITE and text[at + 1] not in _WHITE


def segments(text: str, size: int = SEGMENT) -> list[str]:
    out, start = [], 0
    while len(text) - start > size:
        at = start + size
        while (at := text.find(" ", at)) >= 0 and not safe_cut(text, at):
            at += 1
        if at < 0:
            break
        out.append(text[start:at])
        start = at
    out.append(text[start:])
    return out


class SegmentTree:
    """Token counts of a document's segments; ``sums[1]`` is the total."""

    def __init__(self, text: str, encode: Encoder):
        self._encode = encode
        self.encoded = 0  # characters encoded so far
        self.texts = segments(text)
        self._build([self._count(t) for t in self.texts])

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return self._encode.count(text)

    def _build(self, counts: list[int]) -> None:
        self.width = 1 << max(0, (len(counts) - 1).bit_length())
        self.sums = [0] * self.width + counts + [0] * (self.width - len(counts))
        self.sizes = [0] * self.width + [len(t) for t in self.texts] + [0] * (self.width - len(counts))
        for node in range(self.width - 1, 0, -1):
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            self.sizes[node] = self.sizes[2 * node] + self.sizes[2 * node + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def _find(self, at: int) -> tuple[int, int]:
        """Leaf that holds character ``at`` (the last one beyond the end), and the place of its start."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at - start >= self.sizes[node] and self.sizes[node + 1]:
                start += self.sizes[node]
                node += 1
        return node - self.width, start

    def _set(self, leaf: int, text: str, count: int) -> None:
        self.texts[leaf] = text
        node = leaf + self.width
        self.sums[node], self.sizes[node] = count, len(text)
        while node > 1:
            node //= 2
            self.sums[node] = self.sums[2 * node] + self.sums[2 * node + 1]
            self.sizes[node] = self.sizes[2 * node] + self.sizes[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters start..end by ``new``."""
        length = self.sizes[1]
        start = min(max(start, 0), length)
        end = min(max(end, start), length)
        first, first_at = self._find(max(start - 1, 0))
        last, last_at = self._find(min(end + 1, max(length - 1, 0)))
        region = "".join(self.texts[first : last + 1])
        region = region[: start - first_at] + new + region[end - first_at :]
        while first > 0 and not self._border(first - 1, region, True):
            first -= 1
            region = self.texts[first] + region
        while last + 1 < len(self.texts) and not self._border(last + 1, region, False):
            last += 1
            region += self.texts[last]
        parts = segments(region) if len(region) > LARGE * SEGMENT else [region]
        counts = [self._count(p) for p in parts]
        for leaf in range(first + 1, last + 1):
            self._set(leaf, "", 0)
        if len(parts) == 1:
            self._set(first, region, counts[0])
        else:
            self._rebuild(first, parts, counts)

    def _border(self, leaf: int, region: str, left: bool) -> bool:
        other = self.texts[leaf]
        if not other or not region:
            return False
        return safe_cut(other + region[:2], len(other)) if left else safe_cut(region + other[:2], len(region))

    def _rebuild(self, leaf: int, parts: list[str], counts: list[int]) -> None:
        """The tree with ``parts`` in the place of a leaf; other leaves keep their counts."""
        kept = [(t, self.sums[self.width + k]) for k, t in enumerate(self.texts)]
        kept[leaf : leaf + 1] = zip(parts, counts)
        kept = [x for x in kept if x[0]] or [("", 0)]
        self.texts = [t for t, _ in kept]
        self._build([n for _, n in kept])

    @classmethod
    def stored(cls, texts: list[str], counts: list[int], encode: Encoder) -> SegmentTree:
        """A tree of stored segments; nothing is encoded."""
        tree = cls.__new__(cls)
        tree._encode, tree.encoded, tree.texts = encode, 0, list(texts) or [""]
        tree._build(list(counts) or [0])
        return tree

    def leaves(self) -> tuple[list[str], list[int]]:
        """Segments and their counts, as ``stored`` takes them."""
        held = [(t, self.sums[self.width + k]) for k, t in enumerate(self.texts) if t]
        return [t for t, _ in held], [n for _, n in held]

    def text(self) -> str:
        return "".join(self.texts)


RESULT = "struct<tokens_before:long,tokens_after:long,chars_after:long,segments:long,reencoded_chars:long>"


def count_column(text: Column, edits: Column, tokenizer: str = TOKENIZER) -> Column:
    """Counts before and after ``edits`` (array of struct(start, end, text)) of each whole text."""

    @F.pandas_udf(RESULT)
    def counted(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for texts, lists in batches:
            rows = []
            for t, edit_list in zip(texts, lists):
                tree = SegmentTree(t or "", encode)
                before, built = tree.total, tree.encoded
                for e in [] if edit_list is None else edit_list:
                    if e is not None:
                        tree.edit(int(e["start"] or 0), int(e["end"] or 0), e["text"] or "")
                rows.append((before, tree.total, tree.sizes[1], len(tree.texts), tree.encoded - built))
            yield pd.DataFrame(rows, columns=["tokens_before", "tokens_after", "chars_after", "segments", "reencoded_chars"], dtype="int64")

    return counted(text, edits)


TREE = "struct<segments:array<string>,counts:array<long>,reencoded_chars:long>"


def tree_column(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """The segment tree of each whole text, to be stored: its leaves, from which sums follow without encoding."""

    @F.pandas_udf(TREE)
    def built(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for texts in batches:
            trees = [SegmentTree(t or "", encode) for t in texts]
            yield pd.DataFrame([(*t.leaves(), t.encoded) for t in trees], columns=["segments", "counts", "reencoded_chars"])

    return built(text)


def edited_column(tree: Column, edits: Column, tokenizer: str = TOKENIZER) -> Column:
    """Stored trees after ``edits``; only what the edits touch, with its boundary context, is encoded."""

    @F.pandas_udf(TREE)
    def edited(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer)
        for texts, counts, lists in batches:
            rows = []
            for held, n, edit_list in zip(texts, counts, lists):
                t = SegmentTree.stored(held if held is not None else [], n if n is not None else [], encode)
                for e in [] if edit_list is None else edit_list:
                    if e is not None:
                        t.edit(int(e["start"] or 0), int(e["end"] or 0), e["text"] or "")
                rows.append((*t.leaves(), t.encoded))
            yield pd.DataFrame(rows, columns=["segments", "counts", "reencoded_chars"])

    return edited(tree["segments"], tree["counts"], edits)


def with_counts(docs: DataFrame, edits: Column, text_col: str = "text", out: str = "counts") -> DataFrame:
    """``docs`` with a struct of token counts before and after the edits of each row."""
    return docs.withColumn(out, count_column(F.col(text_col), edits))
