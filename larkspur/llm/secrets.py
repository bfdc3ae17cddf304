"""Secrets in texts: fixed patterns, and values in a credential's place judged by their guess cost.

A candidate is the value after a credential word and ``:``, ``=`` or ``is``. The word can end a longer name (``DB_PASSWORD``);
the short ones start at a letter's edge or a capital (``dbPass``), so that ``compass`` is none. Dynamic programming finds the
cheapest way to guess it as a sequence of dictionary words, dates, repeated blocks, keyboard walks and brute-forced characters;
it is a secret from ``BITS`` bits on, told beside the fixed patterns' spans unless they hold all of it. A value in quotes goes
on to the closing one. Every reading at every place is tried, and costs grow along the value in one pass, whatever its length.

The dictionary is ranked: words that passwords favour come first, then the words of a public tokenizer's vocabulary in the
order of its merges, which is about that of their frequency. The vocabulary's path is a parameter.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from . import common as C

#: Guess cost of a secret; the longest repeated block; bits for the choice of a kind of segment.
BITS, BLOCK, CHOICE = 33.0, 32, 1.0
KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so shorter ones need not be matched to be dropped
_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
_HINTS = ("pass", "pwd", "credential", "auth", "bearer", "secret", "key", "login", "pin", "token")
_CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|passcode|pwd|credentials?|authorization|bearer|(?:client|shared)[_-]?secret|(?:private|access|account|signing|encryption|secret|api)[_-]?key|login|secret|token|(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])))(?:pass|auth|pin))\b["']?(?:[\x20\t]*(?:[:=]|=>)[\x20\t]*|[\x20\t]+is[\x20\t]+)(?:"([^\s"]{6,})"|'([^\s']{6,})'|`([^\s`]{6,})`|["'`]?([^\s"'`,;<>]{6,}))""",
    re.I | re.A,
)
#: Words that passwords favour, tried before all others.
FAVOURED = (
    "password pass love admin welcome monkey dragon letmein master login hello secret summer winter spring autumn shadow sunshine princess football baseball "
    "superman batman freedom whatever trust hunter ranger killer changeme temp user guest test demo example default root sample null none"
).split()
#: The keyboard's rows.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_BESIDE = {c: set(r[max(0, i - 1) : i] + r[i + 1 : i + 2]) for r in ROWS for i, c in enumerate(r)}
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
#: Readings of a date and their bits: a year, and a day of some 200 years without or with a separator of four.
_DATES = [(re.compile(_YEAR), math.log2(200))]
_DATES += [(re.compile(mark.join(order)), math.log2(200 * 366) + extra) for mark, extra in (("", 0), (r"[-/._]", 2)) for order in ((_YEAR, _MONTH, _DAY), (_DAY, _MONTH, _YEAR), (_MONTH, _DAY, _YEAR))]
#: What a sign may stand for in a word.
_LEET = {"4": "a", "@": "a", "3": "e", "0": "o", "1": "il", "!": "i", "5": "s", "$": "s", "7": "t"}
_FOLD = str.maketrans({"l": "i"} | {k: v[0] for k, v in _LEET.items()})


@lru_cache(maxsize=4)
def dictionary(path: str | None) -> tuple[dict[str, list[tuple[str, float]]], int]:
    """Folded spelling to the words with it and their bits, and the longest word's length."""
    words = dict.fromkeys(FAVOURED)
    if path:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        # a word begins with the stand-in of the blank
        blank = bpe.byte_alphabet()[32]
        words.update(dict.fromkeys(t[1:].lower() for t in sorted(vocab, key=vocab.get) if len(t) > 3 and t[0] == blank and t[1:].isascii() and t[1:].isalpha()))
    out: dict[str, list[tuple[str, float]]] = {}
    for rank, word in enumerate(words, 1):
        out.setdefault(word.translate(_FOLD), []).append((word, math.log2(rank + 1)))
    return out, max(map(len, words))


def lowered(value: str) -> str:
    """``value`` in lower case, character by character, so that places stay."""
    return value.lower() if value.isascii() else "".join(x if len(x := c.lower()) == 1 else c for c in value)


def brute_bits(c: str) -> float:
    return math.log2(10) if "0" <= c <= "9" else math.log2(26) if c.isascii() and c.isalpha() else math.log2(33) if c.isascii() else 16.0


def word_bits(own: str, path: str | None) -> float:
    """The cheapest dictionary word that ``own`` may spell: its rank, the ways to set capitals, a bit a stand-in; infinite if none."""
    best, low = math.inf, lowered(own)
    for word, bits in dictionary(path)[0].get(low.translate(_FOLD), ()):
        signs = 0
        for c, w in zip(low, word):
            if c != w:
                if w not in _LEET.get(c, ""):
                    break
                signs += 1
        else:
            best = min(best, bits + signs)
    if best < math.inf:
        upper, letters = sum(map(str.isupper, own)), sum(map(str.isalpha, own))
        few = min(upper, letters - upper)
        if upper:
            best += 1 if own[1:] == low[1:] or own == own.upper() else math.log2(sum(math.comb(letters, k) for k in range(few + 1)))
    return best + CHOICE


def _repeats(value: str) -> dict[int, list[tuple[int, int]]]:
    """For each end the lengths of blocks that stand there twice or more in a row, with how far back the repetition goes."""
    data = np.array(list(map(ord, value)))
    out: dict[int, list[tuple[int, int]]] = {}
    for p in range(1, min(BLOCK, len(value) // 2) + 1):
        same = data[p:] == data[:-p]
        at = np.arange(len(same))
        run = at - np.maximum.accumulate(np.where(same, -1, at))  # how many in a row are the same as ``p`` places before
        for i in np.flatnonzero(same & (run >= p)).tolist():
            out.setdefault(i + p + 1, []).append((p, i + 1 - int(run[i])))
    return out


class _Chain:
    """The cheapest ``best[j] + log2(length from j)`` over starts ``j`` of one run, as its end moves on.

    A start that is no better than an earlier one stays so, as the logarithms draw near; so few are kept.
    """

    def __init__(self):
        self.starts: list[int] = []

    def cheapest(self, best: list[float], end: int, unit: int) -> float:
        low, kept = math.inf, []
        for j in self.starts:
            cost = best[j] + math.log2((end - j) // unit)
            if cost < low:
                low = cost
                kept.append(j)
        self.starts = kept
        return low


def guess_bits(value: str, path: str | None = None, known: dict[str, float] | None = None) -> float:
    """log2 of the fewest guesses for ``value``; 0 for an empty one. ``path``: the vocabulary behind the favoured words.

    A segment costs ``CHOICE`` bits and its own: a word by rank, a date, a block (of up to ``BLOCK`` characters, itself at its
    cheapest) said several times by their number, a walk of three keys or more by its start and length; a brute-forced character
    costs its alphabet.
    """
    n, low, known = len(value), lowered(value), {} if known is None else known
    words, longest = dictionary(path)
    folded = low.translate(_FOLD)
    best = [0.0] + [math.inf] * n
    repeats = _repeats(value) if n > 1 else {}
    chains: dict[tuple[int, int, int], _Chain] = {}
    walk, walked = 1, _Chain()
    for end in range(1, n + 1):
        c, own = low[end - 1], min(best[end], best[end - 1] + brute_bits(value[end - 1]))
        if c.isdigit():
            for pattern, bits in _DATES:
                if m := pattern.match(value, end - 1):
                    best[m.end()] = min(best[m.end()], best[end - 1] + bits + CHOICE)
        for size in range(3, min(longest, end) + 1):
            if folded[end - size : end] in words:
                own = min(own, best[end - size] + word_bits(value[end - size : end], path))
        for p, first in repeats.get(end, ()):
            block = value[end - p : end]
            if block not in known:
                known[block] = brute_bits(block) if p == 1 else guess_bits(block, path, known)
            chain = chains.setdefault((p, first, end % p), _Chain())
            chain.starts.append(end - 2 * p)
            own = min(own, chain.cheapest(best, end, p) + known[block] + CHOICE)
        if end > 1 and c in _BESIDE.get(low[end - 2], ()):
            walk += 1
        else:
            walk, walked = 1, _Chain()
        if walk > 2:
            walked.starts.append(end - 3)
            own = min(own, walked.cheapest(best, end, 1) + math.log2(47) + 1 + CHOICE)
        best[end] = own
    return best[n]


def covered(spans: list[tuple[int, int, int]], start: int, end: int) -> bool:
    """Whether the sorted ``spans`` together hold all of ``start`` to ``end``."""
    for a, _, b in spans:
        if a > start:
            break
        start = max(start, b)
        if start >= end:
            return True
    return start >= end


def find(text: str | None, path: str | None = None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]:
    """Spans ``(start, kind, end)`` of the fixed patterns, spans by guess cost, and the costliest value's bits."""
    if not text:
        return [], [], 0.0
    low = text.lower()
    base, more, bits = [], [], 0.0
    if any(k in low for k in _NAMES):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                base.append((m.start(), 0, m.end()))
                bits = max(bits, guess_bits(m[2], path))
    if "AKIA" in text:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base.sort()
    if any(k in low for k in _HINTS):
        for m in _CONTEXT.finditer(text):
            at = m.start(m.lastindex)
            value = m[m.lastindex].rstrip(".)]}")
            cost = guess_bits(value, path)
            bits = max(bits, cost)
            if cost >= BITS and not covered(base, at, at + len(value)):
                more.append((m.start(), 3, m.end()))
    return base, more, bits


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """``text`` with every span replaced; spans that overlap give one mark."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Counts and spans of each row of ``docs(doc_id, text)``; positions count code points, ends are exclusive.

    Null and empty texts have no spans (counts 0, empty strings, the digest of nothing). Repeated rows and null ids
    give rows of their own; other columns are ignored. ``path``: the vocabulary that ranks words.
    """

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, more, bits = find(text, path)
                kinds = [k for _, k, _ in base]
                rows.append((kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(shown(base).encode()).hexdigest(), shown(base + more), len(more), round(bits, 2)))
            cols = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "guess_bits"])

    docs = C.spread(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(C.tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, guess_bits double")


def redact(docs: DataFrame, mark: str = "[SECRET]", path: str | None = None) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced; ``n_chars``, where there is one, follows the text.

    Null texts stay null, empty ones empty; rows that repeat an id or have none, and further columns, pass through.
    """
    names = docs.columns
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            texts = []
            for text in batch.column(at).to_pylist():
                base, more, _ = find(text, path)
                texts.append(redacted(text, base + more, mark) if base or more else text)
            cols = list(batch.columns)
            cols[at] = pa.array(texts, pa.string())
            if count is not None:
                old = cols[count].to_pylist()
                cols[count] = pa.array([o if t is None else len(t) for o, t in zip(old, texts)], cols[count].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(C.tidy(run), docs.schema)


def op8(spark, sf_dir: str) -> DataFrame:
    return scan(C.read_documents(spark, sf_dir), bpe.vocabulary())
