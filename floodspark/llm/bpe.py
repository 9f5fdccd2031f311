"""BPE encoding by per-prefix dynamic programming, and decoding.

Every prefix of a valid encoding is the encoding of the bytes it covers, so each prefix of a word has
one encoding and thus one last token. An automaton over the vocabulary gives, after each byte, all tokens
that end there; the last token is the one that the encoding before it tolerates: a pair test that
follows both tokens back through their merges. Back-pointers from the end give the ids.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from floodspark.llm import common

#: Words that byte-level BPE keeps apart; a fixed value of the tokenizer files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct pieces whose ids one Python worker remembers at least, steps and borders likewise, and the longest piece.
CACHE, STEPS, LONGEST = 150_000, 75_000, 64
#: Bytes of text that are encoded together.
SLICE_BYTES = 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def byte_level(spec: dict) -> bool:
    """Whether a tokenizer file cuts texts as this module does: no normaliser, the byte-level rule, plain
    merges, and added tokens without white space that match as they stand."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    merges = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    added = all(not x.get("lstrip") and not x.get("rstrip") and not x.get("single_word") and not x.get("normalized") and x["content"].split() == [x["content"]] for x in spec.get("added_tokens") or [])
    return spec.get("normalizer") is None and bool(cuts) and merges and added


def added(spec: dict) -> list[bytes]:
    return [x["content"].encode() for x in spec.get("added_tokens") or []]


# --------------------------------------------------------------------------- pieces of texts
#: ASCII white space, with the separators that some engines count.
WHITE = common.lookup(bytes([*range(9, 14), *range(28, 33)]))
NAME = common.lookup(bytes([*range(48, 58), *range(65, 91), *range(97, 123)]))
MARK = common.lookup(bytes(k for k in range(33, 127) if not chr(k).isalnum()))


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white-space characters; UTF-8 ones have two or three bytes."""
    out = WHITE[data]
    at = np.flatnonzero(data[:-1] == 0xC2)
    at = at[(data[at + 1] == 0x85) | (data[at + 1] == 0xA0)]
    out[at] = out[at + 1] = True
    at = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)) if len(data) > 2 else at[:0]
    a, b, z = data[at], data[at + 1], data[at + 2]
    general = (a == 0xE2) & ((b == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF)) | (b == 0x81) & (z == 0x9F))
    at = at[general | (a == 0xE1) & (b == 0x9A) & (z == 0x80) | (a == 0xE3) & (b == 0x80) & (z == 0x80)]
    out[at] = out[at + 1] = out[at + 2] = True
    return out


def pieces(column: pa.Array, keep: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """The texts cut where a word begins whatever is around, and each text's first piece: pieces encode alone
    as they do in their text.

    Cuts: before a blank and around a line end that stand between two other characters than white
    space, and before an ASCII mark that follows a letter or digit; none inside a string of ``keep``.
    """
    data, offsets = common.utf8(column)
    n, some = len(data), np.diff(offsets) > 0
    solid = ~white(data)
    before, after = np.append(False, solid), np.append(solid[1:], [False, False])
    before[offsets] = after[offsets - 1] = False
    lone = np.append((data == 32) | (data == 10), False) & before & after
    named = NAME[data]
    latin = np.flatnonzero(data[:-1] == 0xC3) + 1
    named[latin] = (data[latin] != 0x97) & (data[latin] != 0xB7)  # letters of two bytes; not the signs among them
    begin = lone.copy()
    begin[np.flatnonzero(lone[:-1] & (data == 10)) + 1] = True
    begin[1:n] |= named[:-1] & MARK[data[1:]]
    for word in keep:
        raw, at = data.tobytes(), -1
        while (at := raw.find(word, at + 1)) >= 0:
            begin[at + 1 : at + len(word)] = False
    begin[offsets[:-1][some]] = True
    begin[n] = False
    start = np.flatnonzero(begin)
    return pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(start, n)), pa.py_buffer(data)]), np.searchsorted(start, offsets)


def encoded(column: pa.Array, keep: list[bytes], ids_of: Callable[[list[bytes]], list[bytes]]) -> tuple[pa.Buffer, np.ndarray]:
    """Ids of all texts in one buffer, and where each text begins in it (bytes); ``ids_of`` gets distinct pieces."""
    parts, first = pieces(column, keep)
    words = parts.dictionary_encode()
    data, cut = common.utf8(words.dictionary)
    raw, cut = data.tobytes(), cut.tolist()
    found = pa.array(ids_of([raw[a:b] for a, b in zip(cut, cut[1:])]), pa.large_binary()).take(words.indices)
    if not len(found):
        return pa.py_buffer(b""), np.zeros(len(first), np.int64)
    return found.buffers()[2], np.frombuffer(found.buffers()[1], np.int64)[: len(found) + 1][first]


def column_of(data: pa.Buffer, cut: np.ndarray) -> pa.Array:
    """Consecutive stretches of a buffer as a binary column."""
    return pa.Array.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(np.ascontiguousarray(cut, np.int64)), data])


class Recent(dict):
    """Values by key, made when missing; holds those of the last ``most`` to twice as many new keys."""

    def __init__(self, make: Callable, most: int) -> None:
        super().__init__()
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        return self.put(key, value)

    def put(self, key, value):
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        if not isinstance(key, bytes) or len(key) <= LONGEST:
            self[key] = value
        return value


class Vocabulary:
    """Tokens are numbered by merge order inside: bytes first, then the merges; ``ids`` has their ids."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        if not byte_level(spec):
            raise ValueError("not a plain byte-level BPE file")
        model, letters = spec["model"], byte_letters()
        raw = {token: bytes(letters[x] for x in token) for token in model["vocab"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = ["".join(m) for m in merges]
        base = [t for t, b in raw.items() if len(b) == 1]
        if len(set(made)) != len(made) or len(base) + len(made) != len(raw):
            raise ValueError("every token must be a byte or come from exactly one merge")
        order = {t: k for k, t in enumerate([*base, *made])}
        self.tokens = [raw[t] for t in order]
        self.ids = [model["vocab"][t] for t in order]
        self.single = len(base)
        self.left, self.right = [-1] * self.single, [-1] * self.single
        self.pair: dict[tuple[int, int], int] = {}
        for k, (a, b) in enumerate(merges):
            self.left.append(order[a])
            self.right.append(order[b])
            self.pair[order[a], order[b]] = self.single + k
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.keep = added(spec)
        self.words = regex.compile(PATTERN)
        self.bytes_of = {i: t for i, t in zip(self.ids, self.tokens)} | {i: s.encode() for s, i in self.special.items()}
        self.tolerated = Recent(self.tolerates, STEPS)
        self.step = Recent(self.follow, STEPS)
        self.piece = Recent(self.encode_piece, CACHE)
        size = max(self.bytes_of) + 1
        self.by_id = pa.array([self.bytes_of.get(i, b"") for i in range(size)], pa.large_binary())
        self._automaton()

    def _automaton(self) -> None:
        """Trie of all tokens with suffix links; ``ends[state]``: tokens that end there, longest first."""
        child: list[dict[int, int]] = [{}]
        own: list[int] = [-1]
        for k, token in enumerate(self.tokens):
            at = 0
            for b in token:
                nxt = child[at].get(b)
                if nxt is None:
                    nxt = child[at][b] = len(child)
                    child.append({})
                    own.append(-1)
                at = nxt
            own[at] = k
        link, ends = [0] * len(child), [()] * len(child)
        todo = deque([0])
        while todo:
            at = todo.popleft()
            for b, nxt in child[at].items():
                back = link[at]
                while at and b not in child[back] and back:
                    back = link[back]
                link[nxt] = child[back][b] if at and b in child[back] else 0
                ends[nxt] = ((own[nxt], *ends[link[nxt]]) if own[nxt] >= 0 else ends[link[nxt]])
                todo.append(nxt)
        self.child, self.link, self.ends = child, link, ends
        self.size = [len(t) for t in self.tokens]

    def follow(self, key: int) -> int:
        """The automaton's state after state ``key >> 8`` and byte ``key & 255``."""
        state, b = key >> 8, key & 255
        while state and b not in self.child[state]:
            state = self.link[state]
        return self.child[state].get(b, 0)

    def tolerates(self, border: int) -> bool:
        """Whether the bytes of two tokens encode to the two: no merge across their border comes in time.

        The border's neighbours are followed back in time, undoing the younger one: a merge of the two
        happens if it is due before the one that used either up (on the left of equals comes first).
        """
        (x, y), due = divmod(border, len(self.tokens)), len(self.tokens)
        while True:
            if self.pair.get((x, y), due) < due:
                return False
            if x > y:
                if x < self.single:
                    return True
                x, due = self.right[x], x
            else:
                if y < self.single:
                    return True
                y, due = self.left[y], y + 1

    def encode_word(self, word: bytes) -> list[int]:
        step, ends, size, tolerated, n = self.step, self.ends, self.size, self.tolerated, len(self.tokens)
        last = [0] * (len(word) + 1)
        state = 0
        for i, b in enumerate(word, 1):
            state = step[state << 8 | b]
            for t in ends[state]:
                before = i - size[t]
                if not before or tolerated[last[before] * n + t]:
                    last[i] = t
                    break
        out, i = [], len(word)
        while i:
            out.append(self.ids[last[i]])
            i -= size[last[i]]
        return out[::-1]

    def encode_piece(self, raw: bytes) -> bytes:
        """Ids of a piece of text as little-endian unsigned 32-bit integers."""
        out, piece = array("I"), raw.decode("utf-8", "replace")
        for part in self.cut.split(piece) if any(x in piece for x in self.special) else (piece,):
            if part in self.special:
                out.append(self.special[part])
            else:
                for word in self.words.findall(part):
                    out.extend(self.encode_word(word.encode()))
        return out.tobytes() if sys.byteorder == "little" else np.array(out, "<u4").tobytes()

    def encode(self, column: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
        """Ids of all texts of a column, and where each text's begin (in bytes)."""
        return encoded(column, self.keep, lambda words: [self.piece[w] for w in words])

    def decode(self, ids: pa.Buffer, cut: np.ndarray) -> pa.Array:
        """The texts of ids; bytes that are no UTF-8 become replacement characters."""
        found = self.by_id.take(pa.array(np.frombuffer(ids, "<u4")[: cut[-1] // 4]))
        if not len(found):
            return pa.array([""] * (len(cut) - 1), pa.string())
        raw = column_of(found.buffers()[2], np.frombuffer(found.buffers()[1], np.int64)[cut // 4])
        try:
            return raw.cast(pa.large_string()).cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x.as_py().decode("utf-8", "replace") for x in raw], pa.string())


def vocabulary(source: str) -> Vocabulary:
    """One for each Python worker and tokenizer file."""
    return common.kept_in_worker(("bpe", hash(source)), lambda: Vocabulary(source))


def encoded_batches(v: Vocabulary, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, ids, n_tokens and decoded text, some MB of text at a time; what a slice took is given back."""
    for batch in batches:
        for part in common.slices(batch, SLICE_BYTES):
            ids, cut = v.encode(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), column_of(ids, cut).cast(pa.binary()), pa.array(np.diff(cut) // 4), v.decode(ids, cut)], ["doc_id", "ids", "n_tokens", "decoded"])
            del ids, cut, part
            common.tidy(alone=False)


def encode_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens and decoded text of every row.

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library; its text, a few MB at
    most whatever the data, is broadcast. A null text counts as empty; a null doc_id stays null; rows
    are independent of each other, so ties and repeated rows need no rule. Other columns are not read.
    """
    common.small_batches(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return encoded_batches(vocabulary(source.value), batches)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids binary, n_tokens long, decoded string")
