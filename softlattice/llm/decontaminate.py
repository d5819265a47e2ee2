"""Benchmark decontamination by canonical templates.

Words become template tokens: numbers, names (capitalised words inside a
sentence) and units (after a number) turn into typed placeholders, anything
else is the lower-cased word without its outer punctuation.  Windows of five
tokens are hash-joined against the benchmark's windows in every reading: as
templates with three literal tokens at least, as the same where capitals that
begin a sentence are names, where four or more capitals in a row are none, and
as the plain words.  Items of under five words are joined whole, word by word.
A hit fixes an alignment of document and item; along it the whole item is
compared, and slots must be consistent: values of the item and values of the
document stand for each other one to one.  An alignment whose slots are not is
rejected as a template, and only words that are the same count in it, in runs of
`run`.  A document is contaminated by an item when `coverage` of the item's tokens match in an alignment or in its runs
of five, or `run` tokens in a row (eight of them literal, or all the same).  So
re-parameterised copies (other numbers, names, units) are caught, and chance
windows are not.

The benchmark is taken in blocks of `block` items and `BLOCK_BYTES` of text (one
item may exceed it); each block is broadcast, and all blocks are asked in one scan
of the documents, so a benchmark of any size works and no text is shuffled.
Texts are whole; however long and repetitive, their hits are held `HITS` at a
time.  Null or empty texts are clean, and without a benchmark all are; null items
and items without a word match nothing.  A short item is found wherever its words
stand, so an item of one common word contaminates every document that has the
word.  Every row is judged by itself: repeated rows, and rows without a doc_id,
get each their own result.  Other columns are passed on by `decontaminate`,
whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import span_hash, splitmix, window_hash, word_bounds, utf8
from .workspace import small_batches

W = 5
BLOCK_BYTES = 16 << 20
HITS = 1 << 20
LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Beside these, flags of a word: a capital that its place may explain, one of four capitals or more in a row, one of a text of capitals.
KIND, MAYBE, CAPITALS, TITLE = 3, 4, 8, 16
_SLOT = splitmix(np.array([0, 71, 72, 73], np.uint64))
#: Units of measure and money.
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces oz pound pounds lb lbs "
    "ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours h day days week weeks month months year years "
    "dollar dollars euro euros cent cents percent degree degrees mph kmh"
).split()


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_PUNCT, _STOP, _DIGIT, _LEAD, _UPPER = _bytes(".,;:!?\"'()[]{}"), _bytes(".!?:;|\""), _bytes("0123456789"), _bytes("$+-#"), _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _bytes("abcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)


@dataclass
class Tokens:
    """Of a batch: template token, plain hash and kind, with its flags, of every word; `doc` has n+1 offsets."""

    template: np.ndarray
    plain: np.ndarray
    kind: np.ndarray
    doc: np.ndarray


def tokens(column: pa.Array) -> Tokens:
    raw, offs = utf8(column)
    start, end, doc = word_bounds(raw, offs)
    if not len(start):
        return Tokens(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8), doc)
    last, first = raw[end - 1], raw[start]
    s, e = start.copy(), end.copy()
    for _ in range(4):
        e -= ((e - s) > 1) & _PUNCT[raw[np.maximum(e - 1, 0)]]
    for _ in range(2):
        s += ((e - s) > 1) & _PUNCT[raw[s]]
    plain = span_hash(raw, s, e)
    head = raw[s]
    second = raw[np.minimum(s + 1, len(raw) - 1)]
    number = _DIGIT[head] | (_LEAD[head] & _DIGIT[second] & (e - s > 1))
    begins = np.ones(len(start), bool)
    line = np.concatenate([[0], np.cumsum(raw == 10)])
    begins[1:] = _STOP[last[:-1]] | (line[start[1:]] > line[end[:-1]])
    begins[doc[:-1][doc[:-1] < len(start)]] = True
    name = _UPPER[first] & ~begins & ~number
    unit = np.zeros(len(start), bool)
    unit[1:] = number[:-1] & np.isin(plain[1:], _unit_hashes())
    unit &= ~begins
    kind = np.select([number, unit, name], [NUMBER, UNIT, NAME], LITERAL).astype(np.uint8)
    return Tokens(np.where(kind == LITERAL, plain, _SLOT[kind]), plain, kind | _capitals(head, kind, doc), doc)


def _capitals(head: np.ndarray, kind: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Flags of every word; only a word that begins with a small letter, or the text's end, ends a row of capitals."""
    big, solid, size = _UPPER[head], ~_LOWER[head], np.diff(doc)
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    first = doc[:-1][size > 0]
    opens[first] = solid[first]
    row = np.maximum(np.cumsum(opens) - 1, 0)
    count, length = (np.bincount(row[mask], minlength=row[-1] + 1)[row] for mask in (solid & big, solid))
    title = (count >= 8) | (length == np.repeat(size, size))
    maybe = big & (kind == LITERAL)
    return (maybe * MAYBE + (big & (count >= 4)) * CAPITALS + (big & (count >= 4) & title) * TITLE).astype(np.uint8)


_units: list[np.ndarray] = []


def _unit_hashes() -> np.ndarray:
    if not _units:
        raw, offs = utf8(pa.array(UNITS))
        start, end, _ = word_bounds(raw, offs)
        _units.append(span_hash(raw, start, end))
    return _units[0]


def _windows(template: np.ndarray, plain: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the windows, in every reading: three literal tokens, or all words as they stand."""
    if len(template) < W:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def some(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask)])
        return sums[W:] - sums[:-W]

    literal, maybe = (kind & KIND) == LITERAL, (kind & MAYBE) > 0
    crowd = ((kind & KIND) == NAME) & ((kind & CAPITALS) > 0)
    at, hashes = [np.flatnonzero(some(literal) >= 3)], [window_hash(template, W)]
    for differs, words, fixed in ((maybe, np.where(maybe, _SLOT[NAME], template), literal & ~maybe), (crowd, np.where(crowd, plain, template), literal | crowd), (~literal, plain, np.ones(len(plain), bool))):
        if differs.any():
            at.append(np.flatnonzero((some(differs) > 0) & (some(fixed) >= 3)))
            hashes.append(window_hash(words, W))
    return np.concatenate(at), np.concatenate([h[i] for h, i in zip(hashes, at, strict=True)])


@dataclass
class Index:
    """A block of items, the sorted hashes of their windows, and the lengths of items too short for one."""

    items: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    hashes: np.ndarray | None = None
    item: np.ndarray | None = None
    at: np.ndarray | None = None
    short: list[int] = field(default_factory=list)


def build_index(rows: list[tuple[int, str | None]]) -> Index:
    out, h, item, at = Index(), [], [], []
    t = tokens(pa.array([r[1] for r in rows], pa.string()))
    for i, (item_id, _) in enumerate(rows):
        lo, hi = t.doc[i], t.doc[i + 1]
        n = int(hi - lo)
        if 0 < n < W:
            pos, hashes = np.zeros(1, np.int64), window_hash(t.plain[lo:hi], n)
            out.short = sorted({*out.short, n})
        else:
            pos, hashes = _windows(t.template[lo:hi], t.plain[lo:hi], t.kind[lo:hi])
        if len(pos):
            h.append(hashes)
            item.append(np.full(len(pos), len(out.items)))
            at.append(pos)
            out.items.append((item_id, t.plain[lo:hi], t.kind[lo:hi], _slots(t.kind[lo:hi])))
    if h:
        order = np.argsort(np.concatenate(h), kind="stable")
        out.hashes, out.item, out.at = np.concatenate(h)[order], np.concatenate(item)[order], np.concatenate(at)[order]
    return out


def _slots(kind: np.ndarray) -> np.ndarray:
    """The kind of slot that a word can be, LITERAL for none; a capital can be a name unless the whole text has them."""
    slot = np.where(kind & MAYBE, NAME, kind & KIND)
    return np.where((slot == NAME) & ((kind & TITLE) > 0), LITERAL, slot)


def _runs(mask: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return list(zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True))


def _one_to_one(at: np.ndarray, kind: np.ndarray, item: np.ndarray, doc: np.ndarray) -> bool:
    """Whether the slots among these positions map the item's values to the document's one to one."""
    at = np.flatnonzero(at & (kind != LITERAL))
    of = lambda *values: len(set(zip(kind[at].tolist(), *(v[at].tolist() for v in values), strict=True)))
    return of(item, doc) == of(item) == of(doc)


def _diagonals(index: Index, pos: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Distinct (item, document position less item position) of all windows that meet, sorted."""
    lo, hi = np.searchsorted(index.hashes, hashes), np.searchsorted(index.hashes, hashes, side="right")
    hit = np.flatnonzero(hi > lo)
    pos, lo, many = pos[hit], lo[hit], (hi - lo)[hit]
    upto = np.cumsum(many)
    out = np.zeros((0, 2), np.int64)
    for first in range(0, int(upto[-1]) if len(upto) else 0, HITS):
        nth = np.arange(first, min(first + HITS, int(upto[-1])))
        row = np.searchsorted(upto, nth, side="right")
        k = lo[row] + nth - (upto[row] - many[row])
        out = np.unique(np.concatenate([out, np.stack([index.item[k], pos[row] - index.at[k]], 1)]), axis=0)
    return out


def _aligned(words: tuple, doc: tuple, d: int) -> tuple[np.ndarray, float, int]:
    """Of one alignment: the item's tokens in runs that count, the share of its tokens that match, and the longest run."""
    (ip, ik, slot), (plain, slots) = words, doc
    a, b, n = max(0, -d), min(len(ip), len(plain) - d), len(ip)
    mask, same, there, inside = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, np.uint64), np.zeros(n, bool)
    there[a:b] = plain[a + d : b + d]
    same[a:b] = ip[a:b] == there[a:b]
    mask[a:b] = same[a:b] | ((slot[a:b] != LITERAL) & (slot[a:b] == slots[a + d : b + d]))
    runs = [(x, y) for x, y in _runs(mask) if y - x >= min(W, n)]
    for x, y in runs:
        inside[x:y] = True
    longest = max((int(y - x) for x, y in _runs(same) if y - x >= min(W, n)), default=0)
    if not _one_to_one(inside, slot, ip, there):
        return np.zeros(n, bool), 0.0, longest
    if not _one_to_one(mask, slot, ip, there):
        mask = inside | same
    longest = max([longest, *(int(y - x) for x, y in runs if ((ik[x:y] & KIND) == LITERAL).sum() >= min(8, n))])
    return inside, float(mask.mean()), longest


def judge(index: Index, template: np.ndarray, plain: np.ndarray, kind: np.ndarray, coverage: float = 0.6, run: int = 13) -> list[tuple[int, float, int]]:
    """(item_id, share of its tokens found, longest run) of every item that contaminates the document."""
    if index.hashes is None:
        return []
    pos, hashes = _windows(template, plain, kind)
    for n in index.short:
        if len(plain) >= n:
            pos, hashes = np.concatenate([pos, np.arange(len(plain) - n + 1)]), np.concatenate([hashes, window_hash(plain, n)])
    pairs = _diagonals(index, pos, hashes)
    if not len(pairs):
        return []
    out, slots = [], _slots(kind)
    items, first = np.unique(pairs[:, 0], return_index=True)
    for i, x, y in zip(items, first, [*first[1:], len(pairs)], strict=True):
        item_id, *words = index.items[i]
        found, longest, share = np.zeros(len(words[0]), bool), 0, 0.0
        for d in pairs[x:y, 1]:
            inside, part, length = _aligned(words, (plain, slots), int(d))
            found |= inside
            share, longest = max(share, part), max(longest, length)
            if share == 1.0 and longest == len(found):
                break
        share = max(share, float(found.mean()))
        if share >= coverage or longest >= run:
            out.append((item_id, share, longest))
    return out


def _blocks(benchmark: DataFrame, block: int):
    rows, size = [], 0
    for item_id, text in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if rows and (len(rows) == block or size + len(text) > BLOCK_BYTES):
            yield rows
            rows, size = [], 0
        rows.append((item_id, text))
        size += len(text)
    if rows:
        yield rows


_FOUND = "array<struct<item_id:long,coverage:double,longest:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("longest", pa.int32())]))


def assess(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6, run: int = 13, block: int = 20_000) -> DataFrame:
    """doc_id and found, a list of (item_id, coverage, longest) of the items that contaminate the row, of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    out = docs.select("doc_id", "text", F.array().cast(_FOUND).alias("found"))
    for rows in _blocks(benchmark, block):
        shared = spark.sparkContext.broadcast(build_index(rows))

        def find(batches, shared=shared):
            index = shared.value
            for batch in batches:
                t = tokens(batch.column("text"))
                more = [judge(index, t.template[a:b], t.plain[a:b], t.kind[a:b], coverage, run) for a, b in zip(t.doc[:-1], t.doc[1:], strict=True)]
                found = batch.column("found").to_pylist()
                for had, new in zip(found, more, strict=True):
                    had += [{"item_id": i, "coverage": share, "longest": longest} for i, share, longest in new]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(found, _FOUND_TYPE)], names=["doc_id", "text", "found"])

        out = out.mapInArrow(find, f"doc_id long, text string, found {_FOUND}")
    return out.select("doc_id", "found")


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6, run: int = 13, block: int = 20_000) -> DataFrame:
    """(doc_id, item_id, coverage, longest) of every row and item that contaminates it."""
    return assess(docs, benchmark, coverage, run, block).select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.6, run: int = 13, block: int = 20_000) -> DataFrame:
    """The rows, with all their columns, that no item contaminates."""
    spark = docs.sparkSession
    small_batches(spark)
    for rows in _blocks(benchmark, block):
        shared = spark.sparkContext.broadcast(build_index(rows))

        def keep(batches, shared=shared):
            index = shared.value
            for batch in batches:
                t = tokens(batch.column(batch.schema.get_field_index("text")))
                ok = [not judge(index, t.template[a:b], t.plain[a:b], t.kind[a:b], coverage, run) for a, b in zip(t.doc[:-1], t.doc[1:], strict=True)]
                yield batch.filter(pa.array(ok, pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, contaminated, items (ids of the benchmark items found, ascending), coverage (the best share)."""
    found = assess(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    items = F.when(F.size("found") > 0, F.array_distinct(F.sort_array(F.col("found.item_id"))))
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), items.alias("items"), F.array_max("found.coverage").alias("coverage"))
