"""BPE encoding and decoding [operator 5].

A word-level BPE with word ends, as its ``tokenizers`` JSON file describes it:
special tokens are found in the raw text, the rest is normalised (NFC, white
space to one space, lower case), split by a pattern, mapped to byte characters
and merged.  The merge loop is the contiguous rank array: the boundaries of a
word's parts and the rank of each adjacent pair stand in two flat lists; the
lowest rank is found by a scan, its boundary deleted and the two neighbouring
ranks refreshed.  Words longer than ``SHORT`` symbols use a heap over the same
ranks, so no word costs the square of its length.

The pattern drops white space and matches nothing across it, so a text is the ids of its
chunks between white space, and each worker keeps the ids of the chunks it has met.

The library's Unicode tables and Python's are of different versions.  Which code points
they class or lower differently is asked of the library once per worker; chunks
that have such a character, or one that Python does not know, are normalised by the
library and split by its classes.  Ids are then those of the library for every code point.

Nulls count as empty; empty texts and texts of white space have no ids; texts of any length are encoded whole;
equal rows have equal results; an empty table gives an empty result; no column but the key and the text is read, so
names cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SHORT = 96
#: Words, and chunks, kept ready in each worker, in two halves; the memory is bounded.
WORDS, CHUNKS = 160_000, 120_000
_LETTER, _NUMBER, _SPACE, _OTHER = range(4)


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if printable in Latin-1, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Unicode:
    """The library's character classes and lower case, and the code points at which Python's differ."""

    def __init__(self):
        from tokenizers import Regex, normalizers

        points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        everything = "".join(points)
        self.nfc, self.lowercase = normalizers.NFC().normalize_str, normalizers.Lowercase().normalize_str
        self.kind = bytearray([_OTHER]) * 0x110000
        ours = bytearray([_OTHER]) * 0x110000
        for name, kind in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _SPACE)):
            rest = set(normalizers.Replace(Regex(f"[{name}]+"), "").normalize_str(everything))
            for c in points:
                if c not in rest:
                    self.kind[ord(c)] = kind
            for c in regex.findall(f"[{name}]", everything):
                ours[ord(c)] = kind
        lowered = self.lowercase("\n".join(points)).split("\n")
        if len(lowered) != len(points) + 1:  # the line feed itself makes one part more
            raise RuntimeError("the library's lower case is not one of single characters")
        at = ord("\n")
        lowered[at : at + 2] = ["\n"]
        self.odd = bytearray(0x110000)
        for c, low in zip(points, lowered):
            i = ord(c)
            self.odd[i] = self.kind[i] != ours[i] or low != lower(c) or unicodedata.category(c) == "Cn"
        for c in points:  # composed or reordered by one of them only
            nfc, apart = unicodedata.normalize("NFC", c), unicodedata.normalize("NFD", c)
            probes = [apart] if apart != c else []
            if unicodedata.combining(c):
                probes += [x + c for x in _MARKS] + [c + x for x in _MARKS]
            if any(self.nfc(x) != unicodedata.normalize("NFC", x) for x in probes):
                for x in c + nfc:
                    self.odd[ord(x)] = 1
        for c, low in zip(points, lowered):  # what becomes such a character is one
            if any(self.odd[ord(x)] for x in low + unicodedata.normalize("NFC", c)):
                self.odd[ord(c)] = 1
        #: White space of Python alone or of the library alone.
        self.unlike = [c for c in points if c.isspace() != (self.kind[ord(c)] == _SPACE)]
        self.space = regex.compile("[" + "".join(regex.escape(c) for c in points if self.kind[ord(c)] == _SPACE) + "]+")

    def chunks(self, text: str) -> list[str]:
        """What stands between the library's white space."""
        if any(c in text for c in self.unlike):
            return [x for x in self.space.split(text) if x]
        return text.split()

    def is_odd(self, text: str) -> bool:
        return not text.isascii() and any(self.odd[ord(c)] for c in text)

    def pieces(self, chunk: str) -> Iterator[str]:
        """The pattern's matches in a normalised chunk, by the library's classes."""
        at, kind = 0, self.kind
        while at < len(chunk):
            end = at + 1
            if suffix := next((x for x in _SUFFIXES if chunk.startswith(x, at)), None):
                end = at + len(suffix)
            elif (k := kind[ord(chunk[at])]) == _SPACE:
                at = end
                continue
            elif k != _NUMBER:
                while end < len(chunk) and kind[ord(chunk[end])] == k:
                    end += 1
            yield chunk[at:end]
            at = end


#: Old combining marks of several classes, to see where a mark is put among them.
_MARKS = "\u0334\u0316\u0301\u0345"
#: What the file's pattern matches before letters, in its order.
_SUFFIXES = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+", re.ASCII)
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def lower(text: str) -> str:
    """Lower case character by character: no word-final sigma."""
    return text.replace("Σ", "σ").lower()


@lru_cache(maxsize=1)
def unicode() -> Unicode:
    return Unicode()


class Kept(dict):
    """Text to what ``make`` gives for it, for at most about twice ``most`` texts: when the newer half is full, the older one goes."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, text: str):
        value = self.older.get(text)
        if value is None:
            value = self.make(text)
            if len(text) > SHORT:
                return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[text] = value
        return value


class WordBpe:
    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # every part that can stand in a word has a number: its id, or one beyond for parts that have none
        self.part: dict[str, int] = dict(self.vocab)
        self.beyond = max(self.vocab.values(), default=-1) + 1
        for a, b in merges:
            for x in (a, b, a + b):
                self.part.setdefault(x, self.beyond + len(self.part))
        self.made = [self.part[a + b] for a, b in merges]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = sorted(self.special, key=len, reverse=True)
        self.special_at = regex.compile("|".join(map(regex.escape, names))) if names else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["pattern"]["Regex"] != _PATTERN:
            raise ValueError("the file splits words by another pattern")
        self.pattern = regex.compile(_PATTERN)
        self.chars = byte_chars()
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.unicode = unicode()
        for c in self.chars:  # bytes that no merge and no id knows
            for x in (c, c + self.end):
                self.part.setdefault(x, self.beyond + len(self.part))
        self.many = max(self.part.values()) + 1
        #: the rank of a pair of parts; ``made`` is the part that each rank makes
        self.ranks = {self.part[a] * self.many + self.part[b]: i for i, (a, b) in enumerate(merges)}
        self.first = [self.part[c] for c in self.chars]
        self.last = [self.part[c + self.end] for c in self.chars]
        self.words = Kept(self._word, WORDS)
        self.numbers = Kept(self._chunk, CHUNKS)
        self.texts = Kept(lambda c: " ".join(map(str, self._chunk(c))), CHUNKS)
        self.shown = {str(i): t for i, t in self.names.items()}

    def merge(self, word: str) -> list[int]:
        """The parts of one word, as numbers."""
        raw = word.encode()
        parts = [self.first[b] for b in raw[:-1]]
        parts.append(self.last[raw[-1]])
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        """The contiguous rank array: ``rank[i]`` is that of parts i and i + 1, whose boundary goes when it is the least."""
        none, many, ranks, made = len(self.made), self.many, self.ranks, self.made
        rank = [ranks.get(a * many + b, none) for a, b in zip(parts, parts[1:])]
        while rank:
            lowest = min(rank)
            if lowest == none:
                break
            i = rank.index(lowest)
            part = parts[i] = made[lowest]
            del parts[i + 1], rank[i]
            if i < len(rank):
                rank[i] = ranks.get(part * many + parts[i + 1], none)
            if i:
                rank[i - 1] = ranks.get(parts[i - 1] * many + part, none)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        part: list[int] = list(parts)
        many, ranks = self.many, self.ranks
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(part, part[1:])) if (r := ranks.get(a * many + b)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] != a or j >= len(part) or part[j] != b:
                continue
            part[i], part[j] = self.made[r], -1
            after[i] = after[j]
            if after[i] < len(part):
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < len(part) and (r := ranks.get(part[left] * many + part[right])) is not None:
                    heapq.heappush(heap, (r, left, part[left], part[right]))
        return [p for p in part if p >= 0]

    def split(self, chunk: str) -> list[str]:
        """The normalised words of a chunk."""
        u = self.unicode
        if chunk.isascii():
            return [chunk.lower()] if chunk.isalpha() else _ASCII.findall(chunk.lower())
        if not u.is_odd(chunk) and not u.is_odd(normal := unicodedata.normalize("NFC", chunk)):
            return self.pattern.findall(lower(normal))
        return list(u.pieces(u.lowercase(u.nfc(chunk))))

    def _word(self, word: str) -> tuple[int, ...]:
        """The ids of a word; parts without one are left out."""
        return tuple(p for p in self.merge(word) if p < self.beyond)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        words = self.split(chunk)
        return self.words[words[0]] if len(words) == 1 else tuple(i for w in words for i in self.words[w])

    def parts(self, text: str) -> Iterator[str | int]:
        """The stretches between special tokens, and the ids of these."""
        at = 0
        for m in self.special_at.finditer(text) if self.special_at and "<" in text else ():
            yield text[at : m.start()]
            yield self.special[m[0]]
            at = m.end()
        yield text[at:] if at else text

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for part in self.parts(text):
            if isinstance(part, int):
                out.append(part)
            else:
                for ids in map(self.numbers.__getitem__, self.unicode.chunks(part)):
                    out.extend(ids)
        return out

    def encode_text(self, text: str) -> str:
        """The ids joined by one space."""
        found = []
        for part in self.parts(text):
            found.append(str(part) if isinstance(part, int) else " ".join(filter(None, map(self.texts.__getitem__, self.unicode.chunks(part)))))
        return " ".join(filter(None, found))

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the file names no decoder.  Unknown ids are left out."""
        return " ".join(self.names[i] for i in ids if i in self.names)

    def decode_text(self, ids: str) -> str:
        """:meth:`decode` of ids joined by one space."""
        return " ".join(filter(None, map(self.shown.get, ids.split(" "))))

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids joined by spaces, SHA-256 of the text decoded from the ids."""
        ids = self.encode_text(text)
        decoded = self.decode_text(ids)
        return ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@lru_cache(maxsize=2)
def parsed(content: str) -> WordBpe:
    return WordBpe(content)


def load(path: str) -> WordBpe:
    with open(path, encoding="utf-8") as f:
        return parsed(f.read())


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _broadcast(df: DataFrame, path: str):
    """The vocabulary file of the driver, a few megabytes whatever the data, for workers that may not have the path."""
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _mapped(docs: DataFrame, path: str, key: str, text: str, schema: pa.Schema, row) -> DataFrame:
    content = _broadcast(docs, path)

    def run(batches):
        model = parsed(content.value)
        for batch in slices(batches):
            rows = [row(model, t.as_py() or "") for t in batch.column(1)]
            columns = list(zip(*rows)) if rows else [[]] * (len(schema) - 1)
            yield pa.record_batch([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:]))], schema=schema)

    from pyspark.sql.pandas.types import from_arrow_schema

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, from_arrow_schema(schema))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _mapped(docs, path, key, text, schema, lambda model, t: (model.encode(t),))


def encode_and_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids, decoded_sha256): the ids of every text, and the SHA-256 of the text decoded from them."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded_sha256", pa.string())])

    def row(model, t):
        ids = model.encode(t)
        return ids, hashlib.sha256(model.decode(ids).encode()).hexdigest()

    return _mapped(docs, path, key, text, schema, row)


def decode(ids: DataFrame, path: str, key: str = "doc_id", column: str = "ids") -> DataFrame:
    """(doc_id, text): the decoded text of every list of ids; null counts as empty."""
    content = _broadcast(ids, path)

    def run(batches):
        model = parsed(content.value)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([model.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return ids.select(F.col(key).cast("long").alias("doc_id"), F.col(column)).mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded and decoded texts, without carrying either."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _mapped(docs, path, key, text, schema, lambda model, t: model.digest(t))
