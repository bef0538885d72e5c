"""Spelling variants: words one edit apart, by a scan of sorted lists with a banded edit matrix.

Of two words one edit apart, the place of the edit (the length of their common prefix) falls into one of a few
intervals, and outside of it they agree. So words meet in groups by what lies outside of an interval: a pair
meets in exactly one group. A group is a sorted list of what lies inside. The scan goes through that list once
for all words looked for: the rows of the edit matrix, three cells each, are worked out for a prefix once for
all entries that share it, as told by the common prefixes of neighbours, and a range of entries whose prefix is
over one edit away already is left as a whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueloom.llm.common import _ASCII_LOWER, discard, release_memory, slices, stored

RUN = re.compile(rb"[A-Za-z\xC0-\xFF]+")
LEAST_LENGTH, LEAST_TIMES = 5, 3
#: One in so many runs loses a code point.
DROP = 97
#: A word's form occurs at least so many times as often.
LEAD = 2
#: Groups of more words are divided by narrower intervals, until those are one place wide.
GROUP = 8192
#: Distinct words that a task counts before it hands them on, rows that it scans at once, and words looked for at once.
COUNTED, SCANNED, SOUGHT = 200_000, 40_000, 8_000


def runs_of(doc_id: int | None, text: str) -> Counter:
    """How often each word occurs in a text, as Latin-1."""
    found = Counter(RUN.findall(text.encode("latin-1", "replace").translate(_ASCII_LOWER)))
    begun, words = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for run, n in found.items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
        if h % DROP == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1 :]
        if len(run) >= LEAST_LENGTH:
            words[run] += n
    return words


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Counter()
    handed = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])
    for cut in slices(batches, 64):
        for doc_id, text in zip(cut["doc_id"], cut["text"]):
            words.update(runs_of(doc_id, text or ""))
            if len(words) >= COUNTED:
                yield handed()
                words = Counter()
    yield handed()
    release_memory()


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words with at least LEAST_LENGTH code points and LEAST_TIMES occurrences."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TIMES)


def matrix_row(row: tuple, hits: tuple) -> list[np.ndarray]:
    """The next row of the band: cells for one letter less, as many and one more of the sought word.

    `hits` says whether the letter at the new place is the sought word's letter before, at and after that place.
    Cells over one edit count as 2.
    """
    less, same, more = row
    first = np.minimum(less + ~hits[0], same + 1)
    second = np.minimum(np.minimum(same + ~hits[1], more + 1), first + 1)
    third = np.minimum(more + ~hits[2], second + 1)
    return [np.minimum(c, 2).astype(np.int8) for c in (first, second, third)]


def _shared_prefixes(letters: np.ndarray, start: np.ndarray, length: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """How many letters each entry shares with the one before it in its group."""
    shared = np.zeros(len(start), np.int64)
    at, depth = np.flatnonzero(~opens), 0
    while len(at):
        at = at[(length[at] > depth) & (length[at - 1] > depth)]
        at = at[letters[start[at] + depth] == letters[start[at - 1] + depth]]
        depth += 1
        shared[at] = depth
    return shared


def scan(entries: list[bytes], group: np.ndarray, sought: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (sought entry, entry) one edit apart, of entries sorted inside of groups.

    `width` is by entry: pairs whose common prefix is that long or longer are left out, as they belong to another
    interval. All sought entries go down the sorted list together, a letter at a time: a state is a sought entry, a
    range of entries that share their first `depth` letters, and the matrix row of that prefix.
    """
    total = len(entries)
    length = np.fromiter(map(len, entries), np.int64, total)
    start = np.cumsum(length) - length
    letters = np.frombuffer(b"".join(entries) + b"\0", np.uint8)
    opens = np.ones(total, bool)
    opens[1:] = group[1:] != group[:-1]
    shared = _shared_prefixes(letters, start, length, opens)
    firsts = np.flatnonzero(opens)
    which = np.cumsum(opens)[sought] - 1
    q, lo, hi = sought, firsts[which], np.append(firsts[1:], total)[which]
    row = [np.full(len(sought), v, np.int8) for v in (2, 0, 1)]
    found, depth, live = [], 0, np.arange(total)
    while len(q):
        keep = (row[1] > 0) | (depth < width[q])
        q, lo, hi, row = q[keep], lo[keep], hi[keep], [c[keep] for c in row]
        here = np.flatnonzero(length[lo] == depth)
        while len(here):  # entries that end here come first in their range
            cell = np.choose(np.clip(length[q[here]] - depth, -2, 2) + 2, (np.int8(2), row[0][here], row[1][here], row[2][here], np.int8(2)))
            hit = here[cell == 1]
            found.append((q[hit], lo[hit]))
            lo[here] += 1
            here = here[lo[here] < hi[here]]
            here = here[length[lo[here]] == depth]
        keep = lo < hi
        q, lo, hi, row = q[keep], lo[keep], hi[keep], [c[keep] for c in row]
        live = live[length[live] > depth]
        if not len(q) or not len(live):
            break
        node = np.cumsum(opens | (shared < depth))
        heads = live[opens[live] | (shared[live] <= depth) | (length[live - 1] <= depth)]  # first entries of ranges that share a letter more
        ends = np.append(np.flatnonzero(opens | (shared <= depth)), total)
        letter = letters[start[heads] + depth].astype(np.int64)
        exact = np.flatnonzero(row[1] == 0)  # no edit yet: every range goes on
        a, b = np.searchsorted(heads, lo[exact]), np.searchsorted(heads, hi[exact])
        many = b - a
        pairs = [(np.repeat(exact, many) << 32) | (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(a, many))]
        spent = np.flatnonzero(row[1] > 0)  # one edit: only letters that a cell goes on with
        key = node[heads] * 256 + letter
        for k, cell in enumerate(row):
            place = depth + k - 1
            go = spent[(cell[spent] == 1) & (place >= 0) & (place < length[q[spent]])]
            want = node[lo[go]] * 256 + letters[start[q[go]] + place]
            slot = np.minimum(np.searchsorted(key, want), len(key) - 1)
            ok = key[slot] == want
            pairs.append((go[ok] << 32) | slot[ok])
        pairs = np.concatenate([pairs[0], np.unique(np.concatenate(pairs[1:]))])
        of, child = pairs >> 32, pairs & 0xFFFFFFFF
        q, lo, c = q[of], heads[child], letter[child]
        hi = ends[np.searchsorted(ends, lo, side="right")]
        places = [depth + k for k in (-1, 0, 1)]
        hits = tuple((p >= 0) & (p < length[q]) & (letters[np.minimum(start[q] + max(p, 0), len(letters) - 1)] == c) for p in places)
        row = matrix_row(tuple(x[of] for x in row), hits)
        near = np.minimum(np.minimum(row[0], row[1]), row[2]) <= 1
        q, lo, hi, row = q[near], lo[near], hi[near], [x[near] for x in row]
        depth += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("lead", pa.int64()), ("near", pa.string())])


def _near_words(rows: dict[str, list]) -> pa.RecordBatch:
    """For each word with near words in whole groups of sorted rows: their number, and the one of largest n."""
    group = np.fromiter(rows["group"], np.int64, len(rows["rem"]))
    entries = [r.encode("latin-1") for r in rows["rem"]]
    prefix, suffix = [k[:s] for k, s in zip(rows["key"], rows["s"])], [k[s + 1 :] for k, s in zip(rows["key"], rows["s"])]
    words = [a + r + b for a, r, b in zip(prefix, rows["rem"], suffix)]
    short = np.fromiter((len(w) == n for w, n in zip(words, rows["length"])), bool, len(words))
    width = np.array(rows["e"], np.int64) - np.array(rows["s"], np.int64)
    sought, n = np.flatnonzero(short), rows["n"]
    found: dict[int, list] = {}
    for at in range(0, len(sought), SOUGHT):
        a, b = scan(entries, group, sought[at : at + SOUGHT], width)
        back = ~short[b]  # longer words aren't sought in this group
        for i, j in zip(np.concatenate((a, b[back])).tolist(), np.concatenate((b, a[back])).tolist()):
            best = found.get(i)
            if best is None:
                found[i] = [1, n[j], words[j]]
                continue
            best[0] += 1
            if n[j] > best[1] or n[j] == best[1] and words[j] < best[2]:
                best[1:] = n[j], words[j]
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([words[i] for i in found], *([v[k] for v in found.values()] for k in range(3))), _NEAR)], schema=_NEAR)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group come in; groups are numbered and scanned whole, many at a time."""
    names = ("length", "s", "e", "key")
    held, last, number = {c: [] for c in (*names, "rem", "n", "group")}, None, 0

    def cut(upto: int) -> pa.RecordBatch:
        part, size = {c: v[:upto] for c, v in held.items()}, Counter(held["group"][:upto])
        some = [k for k, g in enumerate(part["group"]) if size[g] > 1]
        for c, v in held.items():
            del v[:upto]
        return _near_words({c: [v[k] for k in some] for c, v in part.items()})

    for batch in batches:
        columns = batch.to_pydict()
        for key in zip(*(columns[c] for c in names)):
            number += key != last
            last = key
            held["group"].append(number)
        for c in (*names, "rem", "n"):
            held[c] += columns[c]
        if len(held["group"]) >= SCANNED:
            whole = held["group"].index(held["group"][-1])  # the last group may go on
            if whole:
                yield cut(whole)
    yield cut(len(held["group"]))
    release_memory()


_GROUP = ["length", "s", "e", "key"]


def _placed(words: DataFrame) -> DataFrame:
    """(word, n, length, s, e) as rows of groups: what lies outside of the places s to e, and inside."""
    tail = F.greatest(F.col("length") - F.col("e"), F.lit(0))
    return words.select(
        "length", "s", "e",
        F.concat(F.substring("word", F.lit(1), F.col("s")), F.lit("|"), F.substring("word", F.length("word") - tail + 1, tail)).alias("key"),
        F.substring("word", F.col("s") + 1, F.length("word") - tail - F.col("s")).alias("rem"),
        "n",
    )


def _grouped(words: DataFrame, most: int) -> DataFrame:
    """Every word in the groups of two lengths (its own, and as the longer of a pair) and all intervals of each.

    There are two intervals at first, halves of the word; groups over `most` words get halves of theirs.
    """
    interval = lambda s, e: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))
    halves = lambda s, middle, e: F.explode(F.array(interval(s, middle), interval(middle, e))).alias("i")
    sized = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("length")).filter(F.col("length") >= LEAST_LENGTH)
    middle = F.floor((F.col("length") + 1) / 2)
    rows = _placed(sized.select("word", "n", "length", halves(F.lit(0), middle, F.col("length") + 1)).select("word", "n", "length", "i.*"))
    done = []
    while True:
        large = stored(rows.filter("e - s > 1").groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > most).drop("many"))
        if large.isEmpty():
            done.append(rows)
            break
        done.append(rows.join(large, _GROUP, "left_anti"))
        word = F.concat(F.substring("key", F.lit(1), F.col("s")), "rem", F.substring("key", F.col("s") + 2, F.length("key")))
        middle = F.col("s") + F.floor((F.col("e") - F.col("s")) / 2)
        rows = _placed(rows.join(large, _GROUP, "left_semi").select(word.alias("word"), "n", "length", halves(F.col("s"), middle, F.col("e"))).select("word", "n", "length", "i.*"))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return whole


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """Per word of `words(word, n)` that has near words: n_near, and lead and near, the largest n among them and the
    word of it (the smallest of several)."""
    dealt = _grouped(words, group).repartition(*_GROUP).sortWithinPartitions(*_GROUP, "rem")
    found = dealt.mapInArrow(_scanned, "word string, n_near long, lead long, near string")
    best = F.min(F.struct((-F.col("lead")).alias("lead"), "near")).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("best.lead")).alias("lead"), "best.near")


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for `forms(word, form)`: the end of each word's chain of forms, by doubling of pointers."""
    to = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        step = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = stored(to.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(to)
        to = further.drop("moved")
        to.stored_at = further.stored_at
        if further.filter("moved").isEmpty():
            return to


def group_variants(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Per word of all texts of `docs(doc_id, text)`: word, form, root, n, n_near, form_n.

    Runs of letters are counted in every row, equal rows as often as they come; a null text has none, and a null
    doc_id counts as an empty one where runs lose a code point. Ties among forms go to the smallest word in
    code-point order. Words of any length are compared whole. Tables without words give no rows; other columns are
    ignored.

    Tasks count their own words before any is shuffled. Words then meet in groups (see `near_words`), never all
    with all; a group over `group` words is divided, exactly, down to groups of words that differ in one place,
    which no alphabet makes large.
    """
    words = stored(count_words(docs))
    near = words.join(near_words(words, group), "word", "left")
    leads = F.col("lead") >= LEAD * F.col("n")
    formed = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("near")).alias("form"), F.when(leads, F.col("lead")).alias("form_n")))
    discard(words)
    roots = roots_of(formed.filter("form IS NOT NULL"))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
