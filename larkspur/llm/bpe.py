"""Byte-pair encoding and decoding by speculation and verification.

Texts are split at blanks, and the ids of each piece, and of each word in it, are remembered by worker, so that the
work per text is a lookup for each piece. A new word's tokens are first guessed by greedy longest match (one automaton over the whole vocabulary). A guess is
the true encoding exactly if every pair of neighbours is *compatible*: merging the two tokens' bytes from
scratch would end in just these two. All distinct pairs are tested together, in numpy, by undoing merges on
both sides of the seam: at no stage may a merge across the seam come before the merges that were undone. Only
words with a failing pair are merged exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CACHE, SHORT = 160_000, 64
#: Characters of a text, and ids, that are worked on at once.
PART = 1 << 20
#: The word pattern of this family of vocabularies, as published with them.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that count as white space for the pattern (property White_Space).
WHITE = r"\t-\r \x85\xa0  -     　"


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: itself if it is printable Latin-1, else code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Memo:
    """A bounded memory of two generations: what a batch uses is young; when the young are many, the old are forgotten."""

    def __init__(self, limit: int):
        self.limit, self.now, self.old = limit, {}, {}

    def turn(self) -> None:
        if len(self.now) > self.limit:
            self.now, self.old = {}, self.now

    def missing(self, keys: set[str]) -> list[str]:
        """Those of ``keys`` that must be learned; the others are young afterwards."""
        now, old, out = self.now, self.old, []
        for k in keys.difference(now):
            v = old.get(k)
            if v is None:
                out.append(k)
            else:
                now[k] = v
        return out


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        n = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of: list[bytes] = [b""] * n
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for content, i in self.special.items():
            self.bytes_of[i] = content.encode()
        self.byte_id = np.array([vocab[alphabet[b]] for b in range(256)])
        self.to_chars = {b: alphabet[b] for b in range(256)}
        # a merge's rank is its place in the list; a token's rank is that of the merge that makes it, -1 for bytes
        self.rank = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        made: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            made.setdefault((x, y), (r, z))
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        self.byte_list = self.byte_id.tolist()
        self.joined = {x << 24 | y: r << 24 | z for (x, y), (r, z) in made.items()}
        keys = np.array([x * n + y for x, y in made], np.int64)
        order = np.argsort(keys)
        self.n, self.keys = n, keys[order]
        self.ranks = np.array([r for r, _ in made.values()], np.int64)[order]
        self.guess = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.guess.add_word(token, i)
        self.guess.make_automaton()
        self.words = regex.compile(PATTERN.replace(r"\s\p", WHITE.replace("\\", "\\") + r"\p").replace(r"\s", f"[{WHITE}]").replace(r"(?!\S)", f"(?![^{WHITE}])"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known, self.pieces = Memo(CACHE // 4), Memo(CACHE)
        # where blanks meet other white space, a split at blanks is not what the pattern does
        self.odd = re.compile(f" (?:[{WHITE}]|$)")
        sizes = np.array(list(map(len, self.bytes_of)))
        self.blob, self.size = np.frombuffer(b"".join(self.bytes_of), np.uint8), sizes
        self.at = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        self.stats = {"words": 0, "failed": 0}

    def across(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of tokens; a large number where there is none."""
        want = a * self.n + b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], 1 << 50)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair stays two tokens when its bytes are merged from scratch.

        Undo the later of the two tokens' last merges, again and again. A merge across the seam that ranks before
        the merge last undone on its side would have come first, so the pair can't stand; on a tie the left merge wins.
        """
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        # the seam's merge must rank below these to be taken: the left token was built by then, or the right one
        limit = np.full(len(a), 1 << 41, np.int64)
        while len(live):
            x, y = a[live], b[live]
            bad = self.across(x, y) < limit[live]
            ok[live[bad]] = False
            live = live[~bad]
            x, y = a[live], b[live]
            rx, ry = self.rank[x], self.rank[y]
            done = (rx < 0) & (ry < 0)
            live, x, y, rx, ry = (v[~done] for v in (live, x, y, rx, ry))
            # equal ranks: the same merge on both sides, of which the left one is made first
            undo_left = rx > ry
            limit[live] = np.where(undo_left, rx, ry + 1)
            # undoing the left token leaves its right part at the seam, undoing the right one its left part
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return ok

    def exact(self, word: str) -> list[int]:
        """Merge by rank, leftmost first. A long word goes by a heap, in n log n steps; both ways give the same."""
        byte_id, get, none = self.byte_list, self.joined.get, 1 << 60
        ids = [byte_id[b] for b in word.encode("utf-8", "surrogatepass")]
        if len(ids) > SHORT:
            return self._by_heap(ids)
        ranks = [get(x << 24 | y, none) for x, y in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            made = low & 0xFFFFFF
            ids[i : i + 2] = [made]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(made << 24 | ids[i + 1], none)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 24 | made, none)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        """Symbols in a linked list, and a heap of neighbours by rank and place; what has changed since is passed over."""
        get, n = self.joined.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [low << 32 | i for i in range(n - 1) if (low := get(ids[i] << 24 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            low = heappop(heap)
            i, low = low & 0xFFFFFFFF, low >> 32
            j = after[i]
            if ids[i] < 0 or j == n or get(ids[i] << 24 | ids[j]) != low:
                continue
            ids[i], ids[j] = low & 0xFFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (low := get(ids[i] << 24 | ids[k])) is not None:
                    heappush(heap, low << 32 | i)
            h = before[i]
            if h >= 0 and (low := get(ids[h] << 24 | ids[i])) is not None:
                heappush(heap, low << 32 | h)
        return [i for i in ids if i >= 0]

    def learn_words(self, words: set[str]) -> None:
        unknown = self.known.missing(words)
        if unknown:
            self.known.now.update(zip(unknown, self.learn(unknown)))

    def learn_pieces(self, pieces: list[str], words: set[str]) -> None:
        """Remember new pieces, given without the blank before them, and ``words``."""
        # a piece of letters alone is one word, and remembered as a piece only
        plain, mixed = [], []
        for p in pieces:
            (plain if p.isalpha() and (p.isascii() or max(p) < "\u0250") else mixed).append(p)
        inside = [self.words.findall(" " + p) for p in mixed]
        self.learn_words(words.union(*inside))
        if plain:
            self.pieces.now.update(zip(plain, self.learn([" " + p for p in plain])))
        word, join = self.known.now.__getitem__, b"".join
        self.pieces.now.update((p, join(map(word, own))) for p, own in zip(mixed, inside))

    def learn(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words: speculate, verify, and merge the failing ones exactly."""
        shown = ["".join(map(self.to_chars.__getitem__, w.encode("utf-8", "surrogatepass"))) for w in words]
        # no token holds a line feed's own character, so matches never cross words
        text = "\n".join(shown)
        hits = list(self.guess.iter_long(text))
        end = np.fromiter((e for e, _ in hits), np.int64, len(hits))
        ids = np.fromiter((i for _, i in hits), np.int64, len(hits))
        last = np.cumsum([len(s) + 1 for s in shown]) - 2
        stop = np.searchsorted(end, last, "right")
        start = np.concatenate(([0], stop[:-1]))
        inside = np.ones(max(len(ids) - 1, 0), bool)
        seams = stop[:-1] - 1
        inside[seams[(seams >= 0) & (seams < len(inside))]] = False
        at = np.flatnonzero(inside)
        key, back = np.unique(ids[at] * self.n + ids[at + 1], return_inverse=True)
        good = self.compatible(key // self.n, key % self.n)[back]
        owner = np.searchsorted(stop, at, "right")
        failed = np.zeros(len(words), bool)
        failed[owner[~good]] = True
        self.stats["words"] += len(words)
        self.stats["failed"] += int(failed.sum())
        raw = ids.astype("<u4").tobytes()
        return [np.array(self.exact(w), "<u4").tobytes() if f else raw[4 * a : 4 * b] for w, a, b, f in zip(words, start.tolist(), stop.tolist(), failed.tolist())]

    def rest(self) -> None:
        """Forget all words: a worker that waits for its next task holds little."""
        for memo in (self.known, self.pieces):
            memo.now, memo.old = {}, {}

    def apart(self, text: str) -> bool:
        """Whether a text can't be cut at its blanks."""
        return bool(self.odd.search(text)) or any(k in text for k in self.special)

    def remember(self, pieces: list[str], words: set[str]) -> list[bytes]:
        """Ids of distinct pieces, given without the blank before them; ``words`` are known afterwards."""
        self.known.turn()
        self.pieces.turn()
        now, old, fresh = self.pieces.now, self.pieces.old, []
        found = list(map(now.get, pieces))
        for i in [i for i, v in enumerate(found) if v is None]:
            v = found[i] = old.get(pieces[i])
            if v is None:
                fresh.append(i)
            else:
                now[pieces[i]] = v
        self.learn_pieces([pieces[i] for i in fresh], words)
        for i in fresh:
            found[i] = now[pieces[i]]
        return found

    def encode_bytes(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as the vocabulary's library gives them without added tokens: 32 bits each, little-endian.

        A long text goes in parts, cut before blanks between words, where every word begins anew.
        """
        out: list[bytes] = []
        held: list = []
        size = 0
        for s in texts:
            if s and len(s) > PART:
                out += self._encode(held)
                out.append(b"".join(x for part in parts(s) for x in self._encode([part])))
                held, size = [], 0
                continue
            held.append(s)
            size += len(s) if s else 0
            if size > 4 * PART:
                out += self._encode(held)
                held, size = [], 0
        return out + self._encode(held)

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if not texts:
            return []
        self.known.turn()
        self.pieces.turn()
        cut: list = []
        pieces: set[str] = set()
        words: set[str] = set()
        for s in texts:
            if not s:
                cut.append(())
            elif self.apart(s):
                own: list = []
                for part in self.cut.split(s) if self.cut else [s]:
                    if part in self.special:
                        own.append(np.array([self.special[part]], "<u4").tobytes())
                    elif part:
                        own.append(self.words.findall(part))
                        words.update(own[-1])
                cut.append(own)
            else:
                # the first piece has no blank before it
                head, *rest = s.split(" ")
                own = self.words.findall(head)
                words.update(own)
                pieces.update(rest)
                cut.append((own, rest))
        fresh = self.pieces.missing(pieces)
        self.learn_pieces(fresh, words)
        word, join = self.known.now.__getitem__, b"".join
        piece = self.pieces.now.__getitem__
        out = []
        for own in cut:
            if isinstance(own, tuple):
                out.append(join(map(word, own[0])) + join(map(piece, own[1])) if own else b"")
            else:
                out.append(join(x if isinstance(x, bytes) else join(map(word, x)) for x in own))
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        return [np.frombuffer(b, "<u4").tolist() for b in self.encode_bytes(texts)]

    def decode_bytes(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each text's ids, all texts in one gather, a part at a time."""
        counts = [len(b) // 4 for b in ids]
        flat = np.frombuffer(b"".join(ids), "<u4")
        data = []
        for lo in range(0, len(flat), PART):
            part = flat[lo : lo + PART]
            sizes = self.size[part]
            ends = np.cumsum(sizes)
            data.append(self.blob[np.repeat(self.at[part] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes())
        whole, ends = b"".join(data), np.cumsum(self.size[flat])
        edges = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))].tolist()
        return [whole[a:b] for a, b in zip(edges, edges[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes([np.array(ids, "<u4").tobytes()])[0].decode("utf-8", "replace")


def parts(text: str):
    """``text`` in parts of about ``PART`` characters, each but the first from a blank on that stands between two words."""
    at = 0
    while len(text) - at > PART:
        cut = _BETWEEN.search(text, at + PART)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


_BETWEEN = re.compile(f"(?<=[^{WHITE}]) (?=[^{WHITE}])")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def sliced(batch, rows: int = 1024, limit: int = 4 << 20):
    """An Arrow batch in slices of so many rows, or of so many bytes of text, so that one slice's tokens stay few."""
    import pyarrow.compute as pc

    at = batch.schema.get_field_index("text")
    if at < 0:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        return
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < batch.num_rows:
        before = total[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(total, before + limit))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``ids array<int>``; other columns pass through, one named ``ids`` is replaced.

    A null or empty text has no ids. Rows that repeat an id, or have none, are rows of their own; an empty table stays empty.
    """
    out = docs.drop("ids")
    names = out.columns
    at = names.index("text")

    def run(batches):
        for batch in batches:
            for part in sliced(batch):
                ids = codec(path).encode(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*names, "ids"])

    return out.mapInArrow(C.tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema) + ", ids array<int>")


def detokenize(rows: DataFrame, path: str) -> DataFrame:
    """``rows(…, ids)`` with ``decoded string``; a column of that name is replaced, others pass through.

    Null and empty ids decode to an empty text; bytes that are no UTF-8 become replacement characters. Repeated rows give
    repeated results; an empty table stays empty.
    """
    rows = rows.drop("decoded")
    names = rows.columns
    at = names.index("ids")

    def run(batches):
        for batch in batches:
            for part in sliced(batch):
                raw = codec(path).decode_bytes([np.array(i or [], "<u4").tobytes() for i in part.column(at).to_pylist()])
                texts = [b.decode("utf-8", "replace") for b in raw]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return rows.mapInArrow(C.tidy(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", decoded string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each row of ``docs(doc_id, text)``.

    Encodes and decodes in one pass, so that ids never leave the Python worker. A null text counts as empty
    (no tokens); repeated rows give repeated results; a null ``doc_id`` stays null.
    """

    def run(batches):
        own = codec(path)
        for batch in batches:
            for part in sliced(batch):
                ids = own.encode_bytes(part.column(1).to_pylist())
                sha = [hashlib.sha256(x).hexdigest() for x in ids]
                back = [hashlib.sha256(x.decode("utf-8", "replace").encode("utf-8")).hexdigest() for x in own.decode_bytes(ids)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        own.rest()

    docs = C.spread(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return docs.mapInArrow(C.tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7(spark, sf_dir: str) -> DataFrame:
    return round_trip(C.read_documents(spark, sf_dir), vocabulary())
