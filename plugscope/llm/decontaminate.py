"""Benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit verification.

Texts and items are reduced to lower-case letters, digits and single spaces. The CGK walk turns a
string into a longer one: at each step it emits the byte at its place, then stays or moves on, as a
shared random bit for (step, byte) says; edit distance becomes Hamming distance between walks. A
window's length follows the item's (the largest class of at most half of it); items are walked from
every word, texts from every ``STRIDE``-th word, so a passage meets its item at the same word several
times. Each repetition samples ``SAMPLE`` steps of the walk into a key; their number is set by
simulation so that a passage with ``DESIGN_EDITS`` edits per byte meets its item with ``RECALL``.

Walks lose passages with more edits, and those without word starts. So every byte of a text is also a
seed: its next 4 to 8 bytes are looked up among those at every byte of every item, and an item is a
candidate where enough seeds lie on near diagonals. Their length and number are set by simulation for
each class, so that a passage with ``MOST_EDITS`` edits per byte is met with ``RECALL``; exact copies
always are. Candidates are verified with the exact edit distance of the whole item to its best place in the text.

Items are indexed in blocks of ``MOST_BYTES`` of text, one index at a time in a task. Edge cases: null
and empty texts have no hits; very long texts are looked up in pieces, candidates on piece borders
included; items below ``LEAST`` normalised bytes are searched exactly, on word borders (none are needed
in scripts without spaces); empty ones are skipped; repeated items each give a hit; null item ids are
kept. A text's hits depend on it alone. An empty table on either side gives no hits. Extra columns pass
through; one of the result's own name is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, trim

CLASSES = (24, 48, 96)
LEAST = 2 * CLASSES[0]
STRIDE = 4
SAMPLE = 8
MOST_EDITS = 0.2
#: Least share of the other repetitions' samples that agree; unrelated texts agree in about 0.1.
AGREE = 0.5
DESIGN_EDITS = 0.05
RECALL = 0.98
MOST_BYTES = 4_000_000  # text of the items of a block; its index takes up to 80 times as much
_SEED = 20240117
_GROUP = 1 << 13
SEEDS = (8, 7, 6, 5, 4)  # lengths, the first that is sure enough is taken
SURE = 3  # seeds that the longer lengths need
_BAND = 8  # diagonals of a band; two neighbours count together
TOGETHER = 2_000_000  # text bytes that are searched at once
_CHUNK = 1 << 15  # text bytes whose seeds are looked up at once
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\ua4cf\uf900-\ufaff\U00020000-\U0003ffff]")


def _letters() -> np.ndarray:
    out = np.full(256, 32, np.uint8)
    for b in [*range(48, 58), *range(97, 123), *range(128, 256)]:
        out[b] = b
    out[65:91] = np.arange(97, 123)
    return out


_LETTERS = _letters()


def normalise(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes, with a space before and after, and the place of each in ``data``."""
    raw = np.frombuffer(b" " + data + b" ", np.uint8)
    mapped = _LETTERS[raw]
    keep = np.ones(len(mapped), bool)
    keep[1:] = (mapped[1:] != 32) | (mapped[:-1] != 32)
    at = np.flatnonzero(keep)
    return mapped[at], at - 1


def words_of(text: np.ndarray) -> np.ndarray:
    return np.flatnonzero((text[:-1] == 32) & (text[1:] != 32)) + 1


def moves(steps: int) -> np.ndarray:
    """The shared random bits: ``moves[step, byte]``."""
    return np.random.default_rng(_SEED).integers(0, 2, (steps, 256)).astype(np.intp)


def sampled_steps(reps: int) -> dict[int, np.ndarray]:
    """Steps that each repetition samples, for each class; a walk over n bytes takes about 2n steps."""
    rng = np.random.default_rng(_SEED + 1)
    return {size: np.sort([rng.choice(2 * size, SAMPLE, replace=False) for _ in range(reps)], axis=1) for size in CLASSES}


def walk_keys(text: np.ndarray, starts: np.ndarray, sizes: tuple, plan: dict[int, np.ndarray], random: np.ndarray) -> dict[int, np.ndarray]:
    """For each class, keys (repetitions x starts) of the walks from ``starts``; ``text`` ends with enough zeros."""
    wanted: dict[int, list[tuple[int, int]]] = {}
    for size in sizes:
        for rep, steps in enumerate(plan[size]):
            for s in steps:
                wanted.setdefault(int(s), []).append((size, rep))
    keys = {size: np.zeros((len(plan[size]), len(starts)), np.uint64) for size in sizes}
    eight = np.uint64(8)
    for i in range(0, len(starts), _GROUP):
        at = starts[i : i + _GROUP].astype(np.intp)
        byte, move = np.empty_like(at), np.empty_like(at)
        for step in range(max(wanted) + 1 if wanted else 0):
            byte[:] = text.take(at, mode="clip")
            for size, rep in wanted.get(step, ()):
                row = keys[size][rep, i : i + _GROUP]
                np.left_shift(row, eight, out=row)
                np.bitwise_or(row, byte.view(np.uint64), out=row)
            np.take(random[step], byte, out=move, mode="clip")
            at += move
    return keys


_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class SeedTable:
    """Distinct seeds in the order of their hash; the entries of the k-th are ``begins[k]`` to ``begins[k + 1]``."""

    keys: np.ndarray
    begins: np.ndarray
    items: np.ndarray
    places: np.ndarray
    taken: np.ndarray  # slots of the hash that hold a seed
    first: np.ndarray  # the first seed of each slot
    run: int  # the most seeds of a slot

    def find(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``seeds`` are in the table, the place of each in ``keys``)."""
        slot = (seeds * _MIX >> np.uint64(65 - self.taken.size.bit_length())).view(np.int64)
        likely = np.flatnonzero(self.taken.take(slot))
        at, wanted = self.first[slot[likely]], seeds[likely]
        for _ in range(self.run - 1):
            at = at + (self.keys[at] != wanted) * (at < len(self.keys) - 1)
        met = self.keys[at] == wanted
        return likely[met], at[met]


@dataclass
class Index:
    """Keys of item windows by class and repetition; a plain value that travels to the executors."""

    ids: list
    texts: list[bytes]
    sizes: tuple
    plan: dict[int, np.ndarray]
    keys: dict[int, SeedTable] = field(default_factory=dict)  # class -> keys mixed with the repetition, and their windows
    windows: dict[int, np.ndarray] = field(default_factory=dict)  # class -> (item, place in the item) of each window
    samples: dict[int, np.ndarray] = field(default_factory=dict)  # class -> all samples of each window (windows x repetitions)
    reps: int = 0
    seeds: dict[int, SeedTable] = field(default_factory=dict)  # by seed length
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # seeds that make an item a candidate
    short: dict[int, tuple[bytes, int]] = field(default_factory=dict)  # item -> bytes to find, and its place in them


def _mixed(key: np.ndarray, rep: int) -> np.ndarray:
    mixed = (key ^ np.uint64(0xD6E8FEB86659FD93 * (rep + 1) & 0xFFFFFFFFFFFFFFFF)) * _MIX
    return mixed ^ (mixed >> np.uint64(29))


def size_class(length: int) -> int:
    return max(s for s in CLASSES if s <= max(length // 2, CLASSES[0]))


def _edited(text: np.ndarray, rate: float, rng: np.random.Generator) -> np.ndarray:
    out = []
    for b in text.tolist():
        kind = rng.integers(0, 3) if rng.random() < rate else 3
        out += [[], [int(rng.integers(97, 123))], [b, int(rng.integers(97, 123))], [b]][kind]
    return np.array(out, np.uint8)


def repetitions(texts: list[np.ndarray], rate: float = DESIGN_EDITS, recall: float = RECALL, most: int = 48) -> int:
    """The least number of repetitions that reaches the target recall on simulated edits of the items."""
    rng = np.random.default_rng(_SEED + 2)
    plan, random = sampled_steps(most), moves(2 * max(CLASSES))
    met = np.zeros(most)
    tried = texts if len(texts) <= 200 else [texts[i] for i in rng.permutation(len(texts))[:200]]
    for text in tried:
        size = size_class(len(text))
        found = []
        for copy in (text, _edited(text, rate, rng)):
            padded = np.concatenate([[32], copy, np.zeros(2 * size + 2, np.uint8)]).astype(np.uint8)
            starts = words_of(padded[: len(copy) + 1])
            if copy is text:
                starts = starts[starts - 1 + size <= len(text)]
            found.append((walk_keys(padded, starts, (size,), plan, random)[size], starts))
        (mine, at), (theirs, there) = found
        pick = slice(int(rng.integers(STRIDE)), None, STRIDE)
        theirs, there = theirs[:, pick], there[pick]
        near = np.abs(there[:, None] - at[None, :]) <= MOST_EDITS * len(text)
        same = ((theirs[:, :, None] ^ mine[:, None, :])[..., None].view(np.uint8) == 0).sum(axis=-1)
        for reps in range(1, most + 1):
            hit = (same[:reps] == SAMPLE).any(axis=0) & (same[:reps].sum(axis=0) >= SAMPLE + AGREE * SAMPLE * (reps - 1)) & near
            met[reps - 1] += hit.any()
    enough = np.flatnonzero(met >= recall * len(tried))
    return int(enough[0]) + 1 if len(enough) else most


def seed_keys(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place, zeros beyond the end; shorter seeds are their upper bytes."""
    padded = np.concatenate([text, np.zeros(7, np.uint8)]).astype(np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view(">u8")[:, 0].astype(np.uint64) if len(text) else np.zeros(0, np.uint64)


def _upper(keys: np.ndarray, q: int) -> np.ndarray:
    return keys >> np.uint64(64 - 8 * q)


def _pairs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for each place in low..high of each row."""
    n = high - low
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _slices(counts: np.ndarray, most: int = 1 << 16) -> Iterator[slice]:
    """Slices of rows whose counts add up to about ``most`` at a time; rows without any are left out at the ends."""
    ends = np.cumsum(counts)
    at = 0
    while at < len(ends) and ends[-1] > (ends[at - 1] if at else 0):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, stop)
        at = stop


def shared_seeds(text: np.ndarray, copy: np.ndarray, q: int) -> int:
    """The most seeds that both share in two neighbouring bands."""
    mine, theirs = (_upper(seed_keys(t)[: max(len(t) - q + 1, 0)], q) for t in (text, copy))
    order = np.argsort(mine, kind="stable")
    row, at = _pairs(*(np.searchsorted(mine[order], theirs, side) for side in ("left", "right")))
    bands = np.bincount((row - order[at] + len(text)) // _BAND, minlength=2)
    return int((bands[:-1] + bands[1:]).max())


def seed_plan(texts: list[np.ndarray], rate: float = MOST_EDITS, recall: float = RECALL) -> tuple[int, float]:
    """Length of the seeds of a class, and the least share of an item's length that their number must be."""
    rng = np.random.default_rng(_SEED + 3)
    tried = texts if len(texts) <= 200 else [texts[i] for i in rng.permutation(len(texts))[:200]]
    copies = [(t, _edited(t, rate, rng)) for t in tried for _ in range(-(-400 // len(tried)))]
    for q in SEEDS:
        found = np.array([shared_seeds(t, c, q) for t, c in copies])
        share = np.sort(found / [len(t) for t, _ in copies])[int((1 - recall) / 2 * len(copies))]  # half of the losses allowed
        if share * min(len(t) for t in texts) >= (SURE if q > SEEDS[-1] else 1):
            return q, float(share)
    raise ValueError(f"no seed length reaches recall {recall} at {rate} edits per byte")


def _seed_table(entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> SeedTable:
    keys, items, places = (np.concatenate(x) for x in zip(*entries))
    order = np.argsort(keys * _MIX, kind="stable")  # _MIX is odd, so equal hashes are equal seeds
    keys = keys[order]
    starts = np.flatnonzero(np.diff(keys, prepend=~keys[:1]))
    own = keys[starts]
    bits = max(16, math.ceil(math.log2(len(own) * 16)))
    slot = (own * _MIX >> np.uint64(64 - bits)).astype(np.int64)
    taken, first = np.zeros(1 << bits, bool), np.zeros(1 << bits, np.int32)
    taken[slot] = True
    first[slot[::-1]] = np.arange(len(own))[::-1]
    run = int(np.diff(np.flatnonzero(np.diff(slot, prepend=-1, append=-1))).max())
    return SeedTable(own, np.append(starts, len(keys)), items[order], places[order], taken, first, run)


def add_seeds(index: Index, texts: list[np.ndarray], recall: float) -> None:
    entries: dict[int, list] = {}
    index.least = np.ones(len(texts), np.int64)
    for size in index.sizes:
        own = [k for k, t in enumerate(texts) if len(t) >= LEAST and size_class(len(t)) == size]
        q, share = seed_plan([texts[k] for k in own], recall=recall)
        for k in own:
            keys = _upper(seed_keys(texts[k])[: len(texts[k]) - q + 1], q)
            entries.setdefault(q, []).append((keys, np.full(len(keys), k), np.arange(len(keys))))
            index.least[k] = max(1, int(share * len(texts[k])))
    for k, text in enumerate(texts):
        if len(text) < LEAST:
            letters = text.tobytes().decode("utf-8", "replace")
            before, after = (b"" if _UNSPACED.match(c) else b" " for c in (letters[0], letters[-1]))
            wanted = before + text.tobytes() + after
            index.short[k] = wanted, len(before)
            q = min(8, len(wanted))
            key = _upper(seed_keys(np.frombuffer(wanted, np.uint8))[:1], q)
            entries.setdefault(q, []).append((key, np.array([k]), np.zeros(1, np.int64)))
    index.seeds = {q: _seed_table(found) for q, found in entries.items()}


def seeded(index: Index, joined: np.ndarray, bounds: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(text, item, least diagonal) of candidates, and (text, item, place) of short items that are there."""
    short = np.zeros(len(index.texts), bool)
    short[list(index.short)] = True
    longest = max(map(len, index.texts))
    width = int(np.diff(bounds).max(initial=0) + longest) // _BAND + 2
    parts, exact = [], []
    for start in range(0, int(bounds[-1]), _CHUNK):
        stop = min(start + _CHUNK, int(bounds[-1]))
        keys8 = seed_keys(joined[start : stop + 7])[: stop - start]
        near = np.arange(np.searchsorted(bounds, start, "right") - 1, np.searchsorted(bounds, stop))
        owner = np.repeat(near, np.diff(np.clip(bounds[near[0] : near[-1] + 2], start, stop)))  # text of each byte
        for q, table in index.seeds.items():
            likely, found = table.find(_upper(keys8, q))
            row, entry = _pairs(table.begins[found], table.begins[found + 1])
            at, item = likely[row] + start, table.items[entry]
            doc = owner[at - start]
            named = short[item]
            for d, k, a in zip(doc[named].tolist(), item[named].tolist(), at[named].tolist()):
                wanted, lead = index.short[k]
                if joined[a : a + len(wanted)].tobytes() == wanted:
                    exact.append((d, k, a - int(bounds[d]) + lead))
            band = (at - bounds[doc] - table.places[entry] + longest) // _BAND
            parts.append(np.unique(((doc * len(short) + item) * width + band)[~named], return_counts=True))
    if not parts:
        return [], exact
    cells, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    counts = np.bincount(inverse, np.concatenate([p[1] for p in parts]), len(cells)).astype(np.int64)
    # a pair of bands is named by its lower one, which may hold no seed
    pairs = np.sort(np.concatenate([cells, cells - 1]))
    pairs = pairs[np.diff(pairs, prepend=pairs[:1] - 1) > 0]
    count = np.zeros(len(pairs), np.int64)
    count[np.searchsorted(pairs, cells)] += counts
    count[np.searchsorted(pairs, cells - 1)] += counts
    owner = (pairs + 1) // width  # the last band of an owner is never used, so it stands before the first of the next
    enough = count >= index.least[owner % len(short)]
    low = (pairs - owner * width)[enough] * _BAND - longest
    return list(zip((owner[enough] // len(short)).tolist(), (owner[enough] % len(short)).tolist(), low.tolist())), exact


def build(items: list[tuple[object, str]], recall: float = RECALL) -> Index | None:
    ids, texts = [], []
    for item, text in items:
        norm = normalise((text or "").encode("utf-8", "replace"))[0][1:-1]
        if len(norm):
            ids.append(item)
            texts.append(norm)
    if not texts:
        return None
    walked = [t for t in texts if len(t) >= LEAST]
    reps = max(8, repetitions(walked, recall=recall)) if walked else 8
    out = Index(ids, [t.tobytes() for t in texts], tuple(sorted({size_class(len(t)) for t in walked})), sampled_steps(reps), reps=reps)
    add_seeds(out, texts, recall)
    random = moves(2 * max(CLASSES))
    for size in out.sizes:
        windows, samples = [], []
        for k, text in enumerate(texts):
            if len(text) >= LEAST and size_class(len(text)) == size:
                padded = np.concatenate([[32], text, [32], np.zeros(2 * size + 2)]).astype(np.uint8)
                starts = words_of(padded[: len(text) + 1])
                starts = starts[starts - 1 + size <= len(text)]
                samples.append(walk_keys(padded, starts, (size,), out.plan, random)[size].T)
                windows.append(np.stack([np.full(len(starts), k), starts - 1], axis=1))
        out.windows[size], out.samples[size] = np.concatenate(windows), np.concatenate(samples)
        place = np.arange(len(out.windows[size]))
        out.keys[size] = _seed_table([(_mixed(out.samples[size][:, rep], rep), place, place) for rep in range(reps)])
    return out


def best_place(item: bytes, text: bytes, most: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best approximate place of ``item`` in ``text``, if within ``most`` edits."""
    exact = text.find(item)
    if exact >= 0:
        return 0, exact, exact + len(item)

    def ends(pattern: bytes, data: bytes, anchored: bool) -> tuple[int, int]:
        """Least distance and its first end; Myers' bit vectors in one big integer."""
        m = len(pattern)
        full, top = (1 << m) - 1, 1 << (m - 1)
        masks: dict[int, int] = {}
        for i, b in enumerate(pattern):
            masks[b] = masks.get(b, 0) | 1 << i
        up, down, score, best, at = full, 0, m, m, 0
        for j, b in enumerate(data):
            eq = masks.get(b, 0)
            x = eq | down
            zero = (((eq & up) + up) ^ up) | eq
            plus = down | ~(zero | up) & full
            minus = up & zero
            if plus & top:
                score += 1
            elif minus & top:
                score -= 1
            plus = (plus << 1 | anchored) & full
            minus = minus << 1 & full
            up, down = minus | ~(x | plus) & full, plus & x
            if score < best:
                best, at = score, j + 1
        return best, at

    distance, end = ends(item, text, False)
    if distance > most:
        return None
    back = text[max(0, end - len(item) - distance) : end][::-1]
    return distance, end - ends(item[::-1], back, True)[1], end


def least_distances(pieces: list[bytes], regions: list[bytes]) -> np.ndarray:
    """Least distance of each piece, of 1 to 64 bytes, to any place of its region.

    Myers' bit vectors as in ``best_place``, for all pairs at once; zeros behind a region match nothing.
    """
    number = {piece: k for k, piece in enumerate(dict.fromkeys(pieces))}
    masks = np.zeros((len(number), 256), np.uint64)
    free = np.zeros(len(number), np.uint64)  # a piece ends at the top bit; bits below it match all and cost nothing
    for piece, k in number.items():
        low = 64 - len(piece)
        free[k] = (1 << low) - 1
        np.bitwise_or.at(masks, (k, np.frombuffer(piece, np.uint8)), np.uint64(1) << np.arange(low, 64).astype(np.uint64))
    masks = (masks | free[:, None]).reshape(-1)
    which = np.array([number[i] for i in pieces])
    longest = max(1, *map(len, regions))
    text = np.ascontiguousarray(np.frombuffer(b"".join([r.ljust(longest, b"\0") for r in regions]), np.uint8).reshape(-1, longest).T)
    score = np.array([len(i) for i in pieces])
    best = score.copy()
    row, one, sign = which * 256, np.uint64(1), np.int64(63)
    up, down = ~free[which], np.zeros(len(pieces), np.uint64)
    at, eq, zero, plus, step = (np.empty_like(x) for x in (row, up, up, up, score))
    for byte in text:
        np.add(row, byte, out=at)
        np.take(masks, at, out=eq, mode="clip")
        np.bitwise_and(eq, up, out=zero)
        zero += up
        zero ^= up
        zero |= eq
        zero |= down
        np.bitwise_or(zero, up, out=plus)
        np.invert(plus, out=plus)
        plus |= down
        up &= zero  # where the distance falls along the text
        score -= np.right_shift(plus.view(np.int64), sign, out=step)
        score += np.right_shift(up.view(np.int64), sign, out=step)
        plus <<= one
        up <<= one
        np.bitwise_and(plus, zero, out=down)
        plus |= zero
        np.invert(plus, out=plus)
        up |= plus
        np.minimum(best, score, out=best)
    return best


def hopeful(pairs: list[tuple[bytes, bytes, int]]) -> np.ndarray:
    """False only if an (item, region, most edits) needs more edits.

    A region begins ``most`` + 2 bytes before the first place where the item may begin, and ends as many
    after the last one's end. The edits of an item are those of its pieces, and a piece's are its least
    distance to the part of the region that it can reach, or more; a pair is given up as soon as the
    pieces so far need too many.
    """
    bound, most = np.zeros(len(pairs), np.int64), np.array([m for _, _, m in pairs], np.int64)
    alive, first = list(range(len(pairs))), 0
    while alive := [k for k in alive if first < len(pairs[k][0]) and bound[k] <= most[k]]:
        parts = []
        for k in alive:
            item, region, _ = pairs[k]
            piece = item[first : first + 64]
            parts.append((region[first : len(region) - len(item) + first + len(piece)], piece, k))
        parts.sort(key=lambda x: len(x[0]))
        # short batches cost as many steps as long ones, so only much longer regions begin a new one
        cuts = [0]
        for i, (part, _, _) in enumerate(parts):
            if i - cuts[-1] >= 4096 or len(part) > 4 * len(parts[cuts[-1]][0]) + 512:
                cuts.append(i)
        for i, j in zip(cuts, [*cuts[1:], len(parts)]):
            regions, pieces, own = zip(*parts[i:j])
            bound[list(own)] += least_distances(list(pieces), list(regions))
        first += 64
    return bound <= most


def search(index: Index, texts: list[bytes], most_edits: float = MOST_EDITS) -> list[list[tuple]]:
    """Hits of each text: (item id, start, end, distance, similarity); places are bytes of the text."""
    pad = np.zeros(2 * max(CLASSES) + 2, np.uint8)
    pieces, offsets, size = [], [], 0
    for t in texts:
        norm, at = normalise(t)
        pieces.append((norm, at))
        offsets.append(size)
        size += len(norm)
    joined = np.concatenate([p[0] for p in pieces] + [pad])
    bounds = np.array([*offsets, size])
    words = words_of(joined[:size])
    nth = np.arange(len(words)) - np.searchsorted(words, bounds)[np.searchsorted(bounds, words, "right") - 1]
    starts = words[nth % STRIDE == 0]
    random = moves(2 * max(CLASSES))
    asked: set[tuple[int, int, int]] = set()
    for cls, keys in walk_keys(joined, starts, index.sizes, index.plan, random).items():
        for rep in range(index.reps):
            likely, found = index.keys[cls].find(_mixed(keys[rep], rep))
            lows, highs = index.keys[cls].begins[found], index.keys[cls].begins[found + 1]
            for part in _slices(highs - lows):
                row, entry = _pairs(lows[part], highs[part])
                w, own = likely[part][row], index.keys[cls].items[entry]
                same = ((keys[:, w].T ^ index.samples[cls][own]).view(np.uint8) == 0).sum(axis=1)
                enough = same >= SAMPLE + AGREE * SAMPLE * (index.reps - 1)
                at, (item, place) = starts[w[enough]], index.windows[cls][own[enough]].T
                doc = np.searchsorted(bounds, at, "right") - 1
                asked.update(zip(doc.tolist(), item.tolist(), ((at - bounds[doc] - place) // 64 * 64).tolist()))
    found_seeds, exact = seeded(index, joined, bounds)
    hits: list[dict] = [{} for _ in texts]
    for doc, item, place in sorted(exact, reverse=True):
        at = pieces[doc][1]
        hits[doc][item] = (index.ids[item], int(at[place]), int(at[min(place + len(index.texts[item]), len(at) - 1)]), 0, 1.0)
    spans: list[list[int]] = []  # overlapping regions of a text and an item are verified as one
    for doc, item, low in sorted(asked.union(found_seeds)):
        if spans and spans[-1][:2] == [doc, item] and low <= spans[-1][3]:
            spans[-1][3] = low + 64
        else:
            spans.append([doc, item, low, low + 64])
    for first in range(0, len(spans), 1 << 15):
        part = spans[first : first + (1 << 15)]
        wanted = []
        for doc, item, low, high in part:
            text = index.texts[item]
            most = int(most_edits * len(text))
            wanted.append((text, pieces[doc][0][max(0, low - most - 2) : max(0, high + len(text) + most + 2)].tobytes(), most))
        for k in np.flatnonzero(hopeful(wanted)).tolist():
            doc, item, low, _ = part[k]
            text, region, most = wanted[k]
            lo, (norm, at) = max(0, low - most - 2), pieces[doc]
            found = best_place(text, region, most)
            if found and (item not in hits[doc] or found[0] < hits[doc][item][3]):
                distance, s, e = found
                hits[doc][item] = (index.ids[item], int(at[lo + s]), int(at[min(lo + e, len(at) - 1)]), distance, 1 - distance / len(text))
    return [[h for _, h in sorted(d.items())] for d in hits]


HITS = "array<struct<item_id:long,start:long,end:long,distance:int,similarity:double>>"


def hits_column(index: Index | None, text: Column, most_edits: float = MOST_EDITS) -> Column:
    """Hits of each whole text."""
    if index is None:
        return F.lit(None).cast(HITS)

    @F.pandas_udf(HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = []
            part: list[bytes] = []
            size = 0
            for t in texts:
                part.append((t or "").encode("utf-8", "replace"))
                size += len(part[-1])
                if size > TOGETHER:
                    out += search(index, part, most_edits)
                    part, size = [], 0
            if part:
                out += search(index, part, most_edits)
            yield pd.Series([[dict(zip(("item_id", "start", "end", "distance", "similarity"), h)) for h in found] for found in out], dtype=object)
            del out, part, texts
            trim()

    # as if not deterministic: else a filter that an explode implies makes the hits a second time
    return hits.asNondeterministic()(text)


def blocks_of(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", most_bytes: int | None = None) -> Iterator[Index | None]:
    """Indexes of blocks of items whose texts hold about ``most_bytes``; one block unless the table is large."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = max(1, -(-size // (most_bytes or MOST_BYTES)))
    for k in range(count):
        part = items if count == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k)
        yield build(sorted(((r["id"], r["text"]) for r in part.toLocalIterator()), key=lambda x: (x[0] is None, x)))


def with_hits(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "hits") -> DataFrame:
    """``docs`` with the array of hits of each row; empty where the text is clean.

    With more than one block of items the rows are written after each, so that a task holds one index only.
    """
    found = 0
    for index in blocks_of(benchmark):
        if index is not None:
            own = hits_column(index, F.col(text_col))
            docs = materialize(docs, "decontaminated").withColumn(out, F.concat(out, own)) if found else docs.withColumn(out, own)
            found += 1
    return docs if found else docs.withColumn(out, F.array().cast(HITS))
