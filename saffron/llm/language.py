"""Language by cross-parsing entropy.

For each language a suffix automaton over labelled text recognises every
substring of it. A text is parsed into the longest phrases that each automaton
knows; the language that needs the fewest phrases, weighed by the code length of
a phrase, wins. The automata are stored as transition tables, in which a failed
step already points at the start of the next phrase, so that many blocks of
texts advance together as numpy vectors. Texts are parsed whole: blocks of BLOCK
letters are parsed from their first letter all at once, and then once more from the
phrase that the block before left open, until both parses agree.

Tables of DENSE entries in all are plain arrays of states by letters; larger ones,
of many languages or wide alphabets, keep existing transitions only, the rows of
all states interleaved in one array.

The reference text is a bounded sample: ROWS distinct labelled texts for each
language, chosen by a hash, and REFERENCE letters of them. Each text gives an equal
share, from a place in it that the hash chooses; what short texts lack, longer ones
add, up to WIDER shares. All labelled languages are learned; beyond LANGUAGES of them
each gets fewer letters, LEAST at least, so the reference as a whole keeps its size.

Defined results: ``und`` with score 0 if text is null or has no letter, or if
nothing was learned; ties go to the language with more labelled rows, then by
name; repeated rows repeat; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct labelled texts and letters of reference text for each language.
ROWS, REFERENCE = 64, 24_000
#: Shares of the letters that a text may give; languages that get all REFERENCE letters; letters of any.
WIDER, LANGUAGES, LEAST = 4, 512, 256
#: Letters that are parsed at a time, blocks that advance together, and texts whose blocks do.
BLOCK, LANES, TEXTS = 512, 4096, 1024
#: Entries of four bytes that plain tables may take.
DENSE = 12_000_000
_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
Reference = tuple[tuple[str, int, str], ...]  # language, labelled rows, text


def plain(text: str) -> str:
    """Lower case; each run of what is no letter becomes one space."""
    return _OTHER.sub(" ", text.lower())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings."""
    go: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


def _interleaved(go: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, target): the transition of a state by a letter, if any, is at base + letter.

    Rows with several transitions are put at the first place where none of them is
    taken; rows with one fill the gaps.
    """
    many = sorted((s for s in range(len(go)) if len(go[s]) > 1), key=lambda s: -len(go[s]))
    size = 2 * width + 2 * sum(map(len, go)) + 64
    base, owner, target = np.zeros(len(go), np.int32), np.full(size, -1, np.int32), np.zeros(size, np.int32)
    first = width  # all places before it are taken
    for s in many:
        letters = np.fromiter(go[s], np.int64, len(go[s]))
        at = first - int(letters.min())
        while True:
            tries = np.arange(at, at + 256)
            if tries[-1] + width >= len(owner):
                owner, target = (np.concatenate([x, np.full(len(x), fill, np.int32)]) for x, fill in ((owner, -1), (target, 0)))
            good = np.flatnonzero((owner[tries[:, None] + letters] < 0).all(axis=1) & (tries >= 0))
            if len(good):
                break
            at += 256
        base[s] = at + good[0]
        owner[base[s] + letters] = s
        target[base[s] + letters] = list(go[s].values())
        while owner[first] >= 0:
            first += 1
    gaps = iter(np.flatnonzero(owner[width:] < 0) + width)
    for s, out in enumerate(go):
        if len(out) == 1:
            (letter, to), = out.items()
            at = next(gaps)
            base[s], owner[at], target[at] = at - letter, s, to
    return base, owner, target


class Tables:
    """Transition tables of all languages over one alphabet."""

    def __init__(self, reference: Reference) -> None:
        kept = sorted(reference, key=lambda r: (-r[1], r[0]))
        self.names = [r[0] for r in kept]
        letters = sorted({c for r in kept for c in r[2]})
        self.width = len(letters) + 1  # 0: a letter that no reference has
        self.code = np.zeros(0x110000, np.int32)
        self.code[[ord(c) for c in letters]] = np.arange(1, self.width)
        self.bits = [np.log2(max(2, len(text))) for _, _, text in kept]
        dense = 2 * sum(len(r[2]) for r in kept) * self.width <= DENSE
        self.steps = [self._step(suffix_automaton(self.code[[ord(c) for c in text]].tolist()), dense) for _, _, text in kept]

    def _step(self, go: list[dict[int, int]], dense: bool):
        """A function of states and letters: next state times 4, plus the phrases that the step ends.

        A failed step ends the open phrase and starts one with the letter at hand; a letter
        that the language lacks is a phrase by itself.
        """
        root = np.zeros(self.width, np.int32)
        root[list(go[0])] = list(go[0].values())
        failed = root * 4 + 1
        failed[root == 0] = 2
        if dense:
            table = np.repeat(failed[None], len(go), axis=0)
            for state, out in enumerate(go):
                if out:
                    table[state, list(out)] = np.fromiter(out.values(), np.int32, len(out)) * 4
            table[0, root == 0] = 1
            flat, width = table.ravel(), self.width
            return lambda state, letter: flat[state * width + letter]
        base, owner, target = _interleaved(go, self.width)
        target *= 4

        def step(state: np.ndarray, letter: np.ndarray) -> np.ndarray:
            at = base[state] + letter
            return np.where(owner[at] == state, target[at], failed[letter] - (state == 0))

        return step

    def phrases(self, blocks: np.ndarray, lengths: np.ndarray, joined: np.ndarray, carry: list[int], goes_on: bool = False) -> np.ndarray:
        """Phrases that end in each block (columns of letter codes), for each language.

        ``joined`` tells the blocks that go on where the one before ended, ``goes_on`` whether
        a later call does so; ``carry`` holds the states in which the last block of the call
        before ended, and then those of this one.
        """
        n = blocks.shape[1]
        out = np.zeros((len(self.steps), n), np.int64)
        order = np.argsort(-lengths, kind="stable")
        sorted_blocks = np.ascontiguousarray(blocks[:, order])
        running = np.searchsorted(-lengths[order], -np.arange(1, blocks.shape[0] + 1), side="right")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        # After each letter: the state, and the phrases ended so far, by ``place``.
        states, counts = (np.zeros(blocks.shape, np.int32) for _ in range(2))
        last = lengths - 1, place
        for k, step in enumerate(self.steps):
            state, count = np.zeros(n, np.int32), np.zeros(n, np.int32)
            for i, m in enumerate(running):
                if not m:
                    break
                ended = step(state[:m], sorted_blocks[i, :m])
                count[:m] += ended & 3
                state[:m] = ended >> 2
                states[i], counts[i] = state, count
            ends, totals = states[last], counts[last].astype(np.int64)
            end, total = ends.copy(), totals.copy()
            before = np.concatenate([[carry[k]], end[:-1]])
            todo = np.flatnonzero(joined & (before > 0))
            while len(todo):
                lane, state = todo, before[todo]
                count = np.zeros(len(todo), np.int64)
                moved = []
                for i in range(blocks.shape[0]):
                    ended = step(state, blocks[i, lane])
                    count, state = count + (ended & 3), ended >> 2
                    agree = state == states[i, place[lane]]
                    over = ~agree & (lengths[lane] == i + 1)
                    at = lane[agree]
                    total[at] = count[agree] + totals[at] - counts[i, place[at]]
                    moved.append((at, ends[at]))
                    total[lane[over]] = count[over]
                    moved.append((lane[over], state[over]))
                    on = ~(agree | over)
                    lane, state, count = lane[on], state[on], count[on]
                    if not len(lane):
                        break
                at, new = (np.concatenate(x) for x in zip(*moved, strict=True))
                changed = at[new != end[at]]
                end[at] = new
                todo = np.sort(changed + 1)
                todo = todo[todo < n]
                todo = todo[joined[todo]]
                before = np.concatenate([[carry[k]], end[:-1]])
            carry[k] = int(end[-1])
            # A text's last block also ends the open phrase.
            closing = ~np.append(joined[1:], goes_on)
            out[k] = total + (closing & (end > 0))
        return out


@lru_cache(maxsize=2)
def tables(reference: Reference) -> Tables:
    return Tables(reference)


def classify(texts: list[str | None], reference: Reference) -> list[tuple[str, float]]:
    """Language and score of each text."""
    out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    rows = [i for i, t in enumerate(texts) if t and reference and _LETTER.search(t)]
    if not rows:
        return out
    t = tables(reference)
    codes = [t.code[np.frombuffer(plain(texts[i]).encode("utf-32-le"), np.uint32)] for i in rows]
    sizes = np.array([len(c) for c in codes])
    flat = np.concatenate(codes)
    pieces = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(rows)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(np.cumsum(sizes) - sizes, pieces) + nth * BLOCK
    length = np.minimum(BLOCK, np.repeat(sizes, pieces) - nth * BLOCK)
    total, joined = np.zeros((len(t.names), len(rows)), np.int64), nth > 0
    carry = [0] * len(t.names)
    padded = np.concatenate([flat, np.zeros(BLOCK, flat.dtype)])
    for at in range(0, len(owner), LANES):
        lanes = slice(at, at + LANES)
        found = t.phrases(padded[start[lanes][None, :] + np.arange(BLOCK)[:, None]], length[lanes], joined[lanes], carry, bool(joined[at + LANES : at + LANES + 1].any()))
        for k in range(len(t.names)):
            total[k] += np.bincount(owner[lanes], weights=found[k], minlength=len(rows)).astype(np.int64)
    cost = total * np.array(t.bits)[:, None] / sizes  # bits a letter
    best = np.argmin(cost, axis=0)
    spread = np.exp2(-8 * (cost - cost.min(axis=0)))
    score = 1 / spread.sum(axis=0)
    for j, i in enumerate(rows):
        out[i] = (t.names[best[j]], float(min(1.0, score[j])))
    return out


def learn(labelled: DataFrame, rows: int = ROWS, letters: int = REFERENCE, text_col: str = "text", lang_col: str = "lang") -> Reference:
    """Reference text of each language from labelled rows, at most ``rows`` distinct texts a language.

    Of each language the texts of smallest hash are taken, however many copies they
    have. A count of distinct hashes by their bit length gives the bit length up to
    which a language has enough of them, so about twice as many as wanted are read.
    """
    hashed = F.when(F.col(text_col).rlike(r"\p{L}"), F.shiftrightunsigned(F.xxhash64(F.col(text_col).cast("string")), 2))
    known = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), hashed.alias("h"))
    levels = known.groupBy("lang", "h").count().groupBy("lang", F.length(F.bin("h")).alias("bits")).agg(F.sum("count").alias("rows"), F.count("h").alias("texts"))
    # A language has at most 63 bit lengths, one of them null.
    found = levels.collect()
    counts: dict[str, int] = {}
    held: dict[str, int] = {}
    below: dict[str, int] = {}
    for r in sorted(found, key=lambda r: r["bits"] or 0):
        counts[r["lang"]] = counts.get(r["lang"], 0) + r["rows"]
        if r["texts"] and held.get(r["lang"], 0) < rows:
            held[r["lang"]] = held.get(r["lang"], 0) + r["texts"]
            below[r["lang"]] = 1 << r["bits"]
    if not below:
        return ()
    letters = min(letters, max(LEAST, letters * LANGUAGES // len(below)))
    share = {k: -(-letters // min(rows, n)) for k, n in held.items()}
    limits = F.broadcast(labelled.sparkSession.createDataFrame([(k, below[k], WIDER * share[k]) for k in below], "lang string, below long, span int"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for b in batches:
            out = []
            for i, key in enumerate(zip(b.column("lang").to_pylist(), b.column("h").to_pylist(), strict=True)):
                if key not in seen:
                    seen.add(key)
                    text, span = plain(b.column("text")[i].as_py()).strip(), b.column("span")[i].as_py()
                    at = key[1] * 0x9E3779B97F4A7C15 % (1 << 64) % max(1, len(text) - span + 1)
                    out.append((*key, text[at : at + span]))
            cells = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, (pa.string(), pa.int64(), pa.string()), strict=True)], names=["lang", "h", "text"])

    # Copies go, and texts are cut, before they move.
    some = known.join(limits, "lang").where("h < below").select("lang", "h", "text", "span").mapInArrow(pieces, "lang string, h long, text string")
    picked: dict[str, list[str]] = {k: [] for k in below}
    for r in sorted(some.groupBy("lang", "h").agg(F.min("text").alias("text")).collect(), key=lambda r: r["h"]):
        picked[r["lang"]].append(r["text"])
    out = []
    for k in sorted(below, key=lambda k: (-counts[k], k)):
        texts, left = picked[k][:rows], letters
        # Shortest first: what one lacks is shared by those after it.
        gives = {}
        for n, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
            gives[i] = texts[i][: max(1, -(-left // (len(texts) - n)) - 1)]
            left -= len(gives[i]) + 1
        text = "".join(" " + gives[i] for i in range(len(texts)))
        if text.strip():
            out.append((k, counts[k], text[:letters]))
    return tuple(out)


def languages(documents: DataFrame, reference: Reference, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text."""

    shared = documents.sparkSession.sparkContext.broadcast(reference)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TEXTS):
                part = b.slice(at, TEXTS)
                found = classify(part.column(1).to_pylist(), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
