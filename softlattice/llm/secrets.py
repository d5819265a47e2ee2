"""Secret scans: base patterns, and guess-cost of values in credential contexts.

The base spans are those of three patterns.  The method adds spans of kind
`guess`: a value that a credential word introduces (password: x, pwd is x,
Authorization: Bearer x, --api-key x) is cut into words, dates, repeats,
keyboard walks, sequences and brute-force spans so that the product of guesses
is least (dynamic programming over prefixes); a value is a secret from 10^`digits`
guesses on.  The words are a list of common ones, then those of the corpus, most
frequent first (`corpus_words`).  Every credential word is tried, also one that an
earlier word took for its value.  What follows a mere space is running text more
often than a secret, so there it takes 10^(2 `digits`) guesses.  Values have no
least or greatest length.  Values that a base span covers are not reported twice.

Every text is scanned whole, of any length; null counts as empty and gives zero
counts and the hash of the empty string.  Repeated rows give repeated results; an
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, small_batches

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|authorization|credentials?|bearer|login)"""
    r"""["']?\x20{0,4}([:=]{1,2}>?|\x20is\x20|\x20)\x20{0,4}(bearer\x20)?["'`]?([^\s"'`,;<>(){}]+)""",
    re.IGNORECASE | re.ASCII,
)
_NEEDLES = ("passw", "passp", "passc", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "login")
KINDS = ("assign", "access", "hex", "guess")

#: Common password words, most common first.
WORDS = (
    "password admin welcome login letmein master hello dragon monkey shadow sunshine princess football baseball superman batman trustno iloveyou "
    "secret test guest root user access love money summer winter spring autumn monday friday january march april june july august october "
    "changeme default example sample placeholder changeit temp demo null none true false undefined your here value string server service "
    "database mysql postgres redis oracle system manager public private token key api pass word the and for you with this that house green blue black white "
    "orange apple coffee pepper ginger cookie tiger eagle lion horse michael jordan thomas charlie daniel jessica ashley"
).split()
#: A value longer than this may be judged by its first so many characters.
PIECE = 256
_LEET = str.maketrans("4@301!57$", "aaeoiists")
#: Rows of a US keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i + r * 0.5) for r, row in enumerate(ROWS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d", re.ASCII)


def _next_to(a: str, b: str) -> bool:
    if a not in _PLACE or b not in _PLACE:
        return False
    (r, x), (s, y) = _PLACE[a], _PLACE[b]
    return abs(r - s) <= 1 and abs(x - y) <= 1 and a != b


def _brute(text: str) -> float:
    """log10 of guesses for one character, by the classes that occur."""
    size = 26 * any(c.islower() for c in text) + 26 * any(c.isupper() for c in text) + 10 * any(c.isdigit() for c in text) + 33 * any(not c.isalnum() for c in text)
    return math.log10(max(size, 10))


class Guesser:
    """Costs of values; `words` in the order in which they would be guessed, after WORDS."""

    def __init__(self, words: Sequence[str] = ()):
        self.rank = {w: i + 1 for i, w in enumerate(dict.fromkeys([*WORDS, *words]))}
        self.longest = max(map(len, self.rank))

    def cost(self, text: str) -> float:
        """log10 of the guesses of the cheapest segmentation; time is about the length times the longest word."""
        n, single = len(text), _brute(text)
        ends: dict[int, list[tuple[int, float]]] = {}
        for i, j, cost in _spans(text, self.rank, self.longest):
            ends.setdefault(j, []).append((i, cost))
        best = [0.0] * (n + 1)
        for j in range(1, n + 1):
            best[j] = min([best[j - 1] + single, *(best[i] + cost + 0.3 for i, cost in ends.get(j, ()))])
        return best[n]

    def is_costly(self, value: str, digits: float) -> bool:
        """Whether the cost reaches `digits`; a cut through the cheapest segmentation saves less than a short span's brute cost."""
        return (len(value) > PIECE and self.cost(value[:PIECE]) >= digits + 2 * (self.longest + 12)) or self.cost(value) >= digits


def _spans(text: str, ranks: dict[str, int], longest: int):
    """(start, end, log10 guesses) of each word, date, repeat, keyboard walk and sequence."""
    low, n = text.lower(), len(text)
    plain = low.translate(_LEET)
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            rank = ranks.get(low[i:j])
            turned = rank is None and ranks.get(plain[i:j])
            if rank or turned:
                case = text[i:j]
                extra = 0.0 if case == low[i:j] else 0.31 if case[0].isupper() and case[1:] == low[i + 1 : j] else 1.0
                yield i, j, math.log10((rank or turned) + 1) + extra + (0.6 if turned else 0.0)
        if m := _DATE.match(text, i):
            yield i, m.end(), 2.1 if m.end() - i == 4 else 4.6
    for name, step in (("repeat", lambda a, b: a == b), ("walk", _next_to), ("up", lambda a, b: ord(b) - ord(a) == 1), ("down", lambda a, b: ord(a) - ord(b) == 1)):
        i = 0
        while i < n - 1:
            j = i + 1
            while j < n and step(low[j - 1], low[j]):
                j += 1
            if j - i >= 3:
                each = {"repeat": 0.0, "walk": 0.25, "up": 0.0, "down": 0.0}[name]
                yield i, j, math.log10(40) + math.log10(j - i) + each * (j - i)
            i = j
    for unit in range(2, min(n // 2, 12) + 1):  # a block said again
        i = 0
        while i + 2 * unit <= n:
            k = i + unit
            while low[k : k + unit] == low[i : i + unit]:
                k += unit
            if k > i + unit:
                yield i, k, _brute(text[i : i + unit]) * unit + math.log10((k - i) / unit)
                i = k
            else:
                i += 1


_COMMON = Guesser()


def find(text: str | None, digits: float = 10.0, guesser: Guesser = _COMMON) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans in order; start and end count code points."""
    if not text:
        return []
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    low = text.lower()
    if any(x in low for x in _NEEDLES):
        base, at = list(out), 0
        while m := CONTEXT.search(text, at):
            a, end = m.span(4)
            value = text[a:end].rstrip(".:!?")
            b = a + len(value)
            told = m[2] != " " or m[3] or m[1].lower() == "bearer"
            if not any(s <= a and b <= e for s, e, _ in base) and guesser.is_costly(value, digits if told else 2 * digits):
                out.append((a, b, "guess"))
                at = b
            else:  # the value may be, or hold, the word that introduces the secret
                at = max(m.end(1), end - PIECE)  # but who can guess a long value can guess what it holds
    return sorted(set(out), key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def corpus_words(docs: DataFrame, most: int = 20_000, least: int = 5) -> list[str]:
    """Words of 3 to 20 letters, with a small or a great first one, by how many documents hold them: those of `least` at least.  A document with both forms counts twice.

    Every document counts.  A dictionary is a model that goes to each task, so it
    is bounded: the frequency from which words enter is the least (in steps of
    about a hundredth) at which no more than `most` of them do.
    """
    ws = Workspace(docs.sparkSession, "words")
    word = F.explode(F.array_distinct(F.split("text", "[^A-Za-z]+"))).alias("w")
    one = docs.where("text is not null").select(word).where(F.col("w").rlike("^[A-Za-z][a-z]{2,19}$")).select(F.lower("w").alias("w"))
    counts = one.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least).withColumn("step", F.floor(F.log2("n") * 64).cast("int"))
    counts = ws.save(counts, "counts")
    first, held = None, 0
    for step, n in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # 64 steps for each doubling
        held += n
        if held > most:
            break
        first = step
    out = [] if first is None else [r[0] for r in counts.where(F.col("step") >= first).orderBy(F.desc("n"), "w").select("w").collect()]
    ws.drop("counts")
    return out


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, digits: float = 10.0, words: Sequence[str] = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256 and spans of every row; words: see Guesser."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(list(words))

    def run(batches):
        guesser = Guesser(shared.value)
        for batch in batches:
            spans = [find(t, digits, guesser) for t in batch.column("text").to_pylist()]
            count = lambda kind: pa.array([sum(k == kind for _, _, k in x) for x in spans], pa.int64())
            base = [hashlib.sha256(_joined([y for y in x if y[2] != "guess"]).encode()).hexdigest() for x in spans]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(count, KINDS), pa.array(base, pa.string()), pa.array(map(_joined, spans), pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, words=corpus_words(docs))
