"""BPE encoding and decoding with segment trees over the ranks of adjacent pairs.

A piece of text is a row of symbols.  Its segment tree has a leaf for each symbol, which holds the rank of
the pair that begins there joined with its place, or a value above all others; an inner node holds the least
of its children.  So the root yields the leftmost pair of the lowest rank.  A merge changes three leaves and
the nodes above them; merging ends when the root has no pair.

Short pieces go through many trees at once, one row of a matrix each; a long piece has a tree of its own.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

#: White space as Unicode has it, which ends chunks: no piece reaches across it.
SPACE = r"\u0009-\u000d\u0020\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Arrow's own splitting would also cut at these, which are no white space here.
ODD = r"[\x1c-\x1f]"
CUT = "[" + SPACE.encode().decode("unicode_escape") + "]+"
#: Letters and numbers of Unicode 16, which the tokenizers know, that are newer than Python's own tables (15.1): fixed values.
NEW_LETTERS = """1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e 11390-113b5 113b7
    113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"""
NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
#: Capital letters newer than Python's tables, with their small ones: fixed values.
NEW_CAPITALS = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_CAPITALS |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
CAPITALS = frozenset(map(chr, NEW_CAPITALS))
#: Marks whose class the normalisation of the tokenizers does not know, as they are newer than it, and one letter that
#: it does not compose with the one before it: fixed values.
NEW_MARKS = """7fd 898-89f 8ca-8d3 9fe c3c d3b-d3c eba 1715 1abf-1ace 1df6-1dfa a82c 10d24-10d27 10eab-10eac 10efd-10eff 10f46-10f50 10f82-10f85
    11070 1133b 1145e 11839-1183a 1193d-1193e 11943 119e0 11a34 11a47 11a99 11d42 11d44-11d45 11d97 11f41-11f42 16ff0-16ff1 1e08f 1e130-1e136
    1e2ae 1e2ec-1e2ef 1e4ec-1e4ef 11930"""
MARKS = frozenset(chr(c) for r in NEW_MARKS.split() for c in range(int(r.partition("-")[0], 16), int(r.rpartition("-")[2], 16) + 1))
APART = regex.compile("([" + "".join(MARKS) + "])")
#: Pieces of up to so many bytes are merged together, up to so many in one matrix.
SHORT, ROWS = 64, 4096
#: Texts are encoded in groups of about so many bytes.
GROUP_BYTES = 4_000_000
NO_PAIR = np.int32(2**31 - 1)
#: No id and no pair of ids has these values: vocabularies have less than 65,535 ids.
NO_ID, NO_KEY = np.uint16(0xFFFF), np.uint32(0xFFFFFFFF)


def _within(code: int, ranges: str) -> bool:
    return any(int(a, 16) <= code <= int(b or a, 16) for a, _, b in (r.partition("-") for r in ranges.split()))


def _stand_in(c: str) -> str:
    """A character of the same class as one that Python's tables do not know."""
    return "a" if _within(ord(c), NEW_LETTERS) else "1" if _within(ord(c), NEW_NUMBERS) else "!"


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabularies of byte-level BPE."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + others.index(b)) for b in range(256)]


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a large string array, and where each value's begin; there is one limit more."""
    offsets = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    return np.frombuffer(strings.buffers()[2] or b"", np.uint8), offsets


def _gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs [begin, begin + size) of the pool, one after the other."""
    ends = np.cumsum(size)
    return pool[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Chunks:
    """The ids of chunks between white space: a chunk has a slot, whose ids lie in a pool."""

    def __init__(self):
        self.slots: dict[str, int] = {"": 0}
        self.begin, self.size = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.pool, self.used = np.zeros(0, np.uint32), 0

    def __len__(self) -> int:
        return len(self.slots)

    def add(self, chunks: Sequence[str], ids: np.ndarray, size: np.ndarray) -> None:
        n = len(self.slots)
        self.slots.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        if len(self.begin) < len(self.slots):
            room = np.zeros(len(self.slots), np.int64)  # half as much again
            self.begin, self.size = np.append(self.begin, room), np.append(self.size, room)
        if len(self.pool) < self.used + len(ids):
            self.pool = np.append(self.pool, np.zeros(self.used + len(ids), np.uint32))
        self.begin[n : n + len(chunks)], self.size[n : n + len(chunks)] = self.used + np.cumsum(size) - size, size
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)


class Vocabulary:
    """A tokenizer file with word ends: normalisation NFC and lower case, splitting by a pattern, byte-level BPE.

    ``encode_column`` gives the ids of an Arrow column of texts.  The ids of chunks between white space are kept in
    two tables of at most ``kept`` chunks; when the newer is full, the older goes.
    """

    def __init__(self, path: str, kept: int = 450_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = dict(model["vocab"])
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE) + r"|\n")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        end, letters = model["end_of_word_suffix"], byte_letters()
        self.first = np.array([self.ids[x] for x in letters], np.uint16)  # of a byte inside a word
        self.last = np.array([self.ids[x + end] for x in letters], np.uint16)  # of a word's last byte
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([self.ids[a] for a, _ in pairs], np.int64)
        right = np.array([self.ids[b] for _, b in pairs], np.int64)
        self.merged = np.array([self.ids[a + b] for a, b in pairs], np.uint16)  # by rank
        if len(self.ids) >= NO_ID:
            raise ValueError(f"{path}: {len(self.ids)} ids")
        self._hash_pairs(((left << 16) | right).astype(np.uint32))
        self.rank_of: dict[int, int] = {}
        self.kept, self.table, self.older = kept, Chunks(), Chunks()

    # -- ranks ---------------------------------------------------------------------------------------------

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.bits)

    def _hash_pairs(self, keys: np.ndarray) -> None:
        """Open addressing; a pair's rank is found in at most ``probes`` looks.  A key is left << 16 | right."""
        self.bits = max(8, int(np.ceil(np.log2(max(len(keys), 1) * 8))))
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size + 64, NO_KEY, np.uint32), np.full(size + 64, NO_PAIR, np.int32)
        slots, self.probes = self._slot(keys).tolist(), 1
        for rank, (key, slot) in enumerate(zip(keys.tolist(), slots, strict=True)):
            looks = 1
            while self.keys[slot] not in (NO_KEY, key):
                slot, looks = slot + 1, looks + 1
            if self.keys[slot] == NO_KEY:
                self.keys[slot], self.ranks[slot] = key, rank
            self.probes = max(self.probes, looks)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, NO_PAIR where there is none; NO_ID pairs with nothing."""
        keys = (left.astype(np.uint32) << np.uint32(16)) | right.astype(np.uint32)
        slot = self._slot(keys)
        there = self.keys[slot]
        found = np.where(there == keys, self.ranks[slot], NO_PAIR)
        rest = np.flatnonzero((there != keys) & (there != NO_KEY))
        for step in range(1, self.probes):
            if not len(rest):
                break
            at = slot[rest] + np.uint32(step)
            hit = self.keys[at] == keys[rest]
            found[rest[hit]] = self.ranks[at[hit]]
            rest = rest[~hit & (self.keys[at] != NO_KEY)]
        return found

    def _rank_one(self, left: int, right: int) -> int:
        key = (left << 16) | right
        if (r := self.rank_of.get(key)) is None:
            if len(self.rank_of) > 200_000:
                self.rank_of.clear()
            r = self.rank_of[key] = int(self.rank(np.array([left]), np.array([right]))[0])
        return r

    # -- merging -------------------------------------------------------------------------------------------

    def _symbols(self, piece: bytes) -> np.ndarray:
        raw = np.frombuffer(piece, np.uint8)
        out = self.first[raw]
        out[-1] = self.last[raw[-1]]
        return out

    def _merge_rows(self, raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge pieces, the bytes of each in a row of ``raw``, whose width is a power of two: a tree in each row.

        Gives the ids of all rows, one after the other, and how many each row has.
        """
        n, width = raw.shape
        place = np.arange(width, dtype=np.int32)
        symbols = np.where(place < size[:, None], self.first[raw], NO_ID)
        rows = np.arange(n, dtype=np.int32)
        symbols[rows, size - 1] = self.last[raw[rows, size - 1]]
        right = np.where(place + 1 < size[:, None], place + 1, -1).astype(np.int8)
        left = np.broadcast_to((place - 1).astype(np.int8), (n, width)).copy()
        tree = np.full((n, 2 * width), NO_PAIR, np.int32)
        if width > 1:
            ranks = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
            tree[:, width : 2 * width - 1] = np.where(ranks < NO_PAIR, ranks * width + place[:-1], NO_PAIR)
            for k in range(width - 1, 0, -1):
                np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        alive = np.flatnonzero(tree[:, 1] < NO_PAIR)
        while len(alive):
            root = tree[alive, 1]
            at, new = root % width, self.merged[root // width]
            gone = right[alive, at]
            after, before = right[alive, gone], left[alive, at]
            symbols[alive, at] = new
            symbols[alive, gone] = NO_ID
            right[alive, at] = after
            k = np.flatnonzero(after >= 0)
            left[alive[k], after[k]] = at[k]
            after_id = np.where(after >= 0, symbols[alive, after], NO_ID)
            ranks = self.rank(new, after_id)
            self._update(tree, alive, width + gone.astype(np.int32), np.full(len(alive), NO_PAIR), width)
            self._update(tree, alive, width + at, np.where(ranks < NO_PAIR, ranks * width + at, NO_PAIR), width)
            k = np.flatnonzero(before >= 0)
            if len(k):
                rows, at = alive[k], before[k].astype(np.int32)
                ranks = self.rank(symbols[rows, at], new[k])
                self._update(tree, rows, width + at, np.where(ranks < NO_PAIR, ranks * width + at, NO_PAIR), width)
            alive = alive[tree[alive, 1] < NO_PAIR]
        keep = symbols != NO_ID
        return symbols[keep].astype(np.uint32), keep.sum(axis=1)

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray, width: int) -> None:
        tree[rows, leaf] = value
        while width > 1:
            width >>= 1
            value = np.minimum(value, tree[rows, leaf ^ 1])
            leaf = leaf >> 1
            tree[rows, leaf] = value

    def _merge_long(self, piece: bytes) -> np.ndarray:
        symbols = self._symbols(piece)
        n = len(symbols)
        width = 1 << max(0, n - 1).bit_length()
        none = 1 << 62
        ranks = np.full(width, NO_PAIR, np.int64)
        ranks[: n - 1] = self.rank(symbols[:-1], symbols[1:])
        level = np.where(ranks < NO_PAIR, ranks * width + np.arange(width), none)
        levels = [level]
        while len(level) > 1:
            levels.append(level := np.minimum(level[::2], level[1::2]))
        tree = [none, *np.concatenate(levels[::-1]).tolist()]
        ids, right, left = symbols.tolist(), [*range(1, n), -1], [*range(-1, n - 1)]

        def put(at: int, value: int) -> None:
            k = width + at
            tree[k] = value
            while k > 1:
                k >>= 1
                value = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == value:
                    break
                tree[k] = value

        while (root := tree[1]) < none:
            rank, at = divmod(root, width)
            new, gone, before = int(self.merged[rank]), right[at], left[at]
            after = right[gone]
            ids[at], ids[gone], right[at] = new, -1, after
            put(gone, none)
            if after >= 0:
                left[after] = at
            r = self._rank_one(new, ids[after]) if after >= 0 else none
            put(at, r * width + at if r < NO_PAIR else none)
            if before >= 0:
                r = self._rank_one(ids[before], new)
                put(before, r * width + before if r < NO_PAIR else none)
        return np.array([x for x in ids if x >= 0], np.int64)

    def merge(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces, none of which is empty: a pool of ids, and where in it each piece's begin and how many it has."""
        data, offsets = _bytes_of(pieces)
        length = np.diff(offsets)
        begin, size = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        pool, used = [np.zeros(0, np.uint32)], 0
        for i in np.flatnonzero(length > SHORT).tolist():
            pool.append(self._merge_long(data[offsets[i] : offsets[i + 1]].tobytes()).astype(np.uint32))
            begin[i], size[i] = used, len(pool[-1])
            used += len(pool[-1])
        width = 1
        while width <= SHORT:
            members = np.flatnonzero((length > width // 2) & (length <= width))
            for k in range(0, len(members), ROWS):
                part = members[k : k + ROWS]
                at = offsets[part][:, None] + np.arange(width)
                ids, number = self._merge_rows(data[np.minimum(at, len(data) - 1)], length[part])
                begin[part], size[part] = used + np.cumsum(number) - number, number
                pool.append(ids)
                used += len(ids)
            width *= 2
        return np.concatenate(pool), begin, size

    # -- texts ---------------------------------------------------------------------------------------------

    def _plain(self, text: str) -> str:
        if not text.isascii():
            if MARKS.isdisjoint(text):
                text = unicodedata.normalize("NFC", text)
            else:  # marks that the tokenizers' normalisation does not know stay where they are, and nothing passes them
                text = "".join([x if k % 2 else unicodedata.normalize("NFC", x) for k, x in enumerate(APART.split(text))])
            if "Σ" in text:  # letter by letter, as str.lower() would make the last sigma of a word another letter
                text = "".join([c.lower() for c in text])
            if not CAPITALS.isdisjoint(text):
                text = text.translate(NEW_CAPITALS)
        return text.lower()

    def _split(self, plain: str) -> list[str]:
        """The pieces of a text whose chunks are divided by line feeds; a line feed is a piece."""
        # The regex library classes some unassigned characters in ways of its own: it gets to see others for them.
        unknown = {} if plain.isascii() else {ord(c): _stand_in(c) for c in set(plain) if unicodedata.category(c) == "Cn"}
        if unknown:
            return [plain[m.start() : m.end()] for m in self.pieces.finditer(plain.translate(unknown))]
        return self.pieces.findall(plain)

    def _learn_special(self, chunk: str) -> np.ndarray:
        parts = self.specials.split(chunk)
        found = [np.array([self.special[x]], np.uint32) if k % 2 else self.learn([x])[0] for k, x in enumerate(parts) if x]
        return np.concatenate(found)

    def learn(self, chunks: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, none of which is empty or has white space, one after the other, and how many each has."""
        if any("<|" in c for c in chunks) and (special := [i for i, c in enumerate(chunks) if self.specials.search(c)]):
            ids, size = self.learn([c for c in chunks if not self.specials.search(c)])
            own = [self._learn_special(chunks[i]) for i in special]
            sizes = np.zeros(len(chunks), np.int64)
            plain = np.ones(len(chunks), bool)
            plain[special] = False
            sizes[plain], sizes[special] = size, [len(x) for x in own]
            begin = np.zeros(len(chunks), np.int64)
            begin[plain], begin[special] = np.cumsum(size) - size, len(ids) + np.cumsum([0, *map(len, own)][:-1])
            return _gather(np.concatenate([ids, *own]), begin, sizes), sizes
        if not len(chunks):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pieces = pa.array(self._split(self._plain("\n".join(chunks)) + "\n"), pa.large_string()).dictionary_encode()
        which = pieces.indices.to_numpy()
        line = pieces.dictionary.index("\n").as_py()
        pool, begin, size = self.merge(pieces.dictionary)
        size[line] = 0
        size = size[which]
        ends = np.flatnonzero(which == line)
        return _gather(pool, begin[which], size), np.diff(np.cumsum(size)[ends], prepend=0)

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and their limits; ``end_id``, if given, follows each text.

        A null text counts as empty.
        """
        texts = texts.fill_null("")
        weight = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        ids, sizes, begin = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while begin < len(texts):  # some MB of text at a time
            until = int(np.searchsorted(weight, (weight[begin - 1] if begin else 0) + GROUP_BYTES, "right"))
            until = max(until, begin + 1)
            found, size = self._encode_some(texts[begin:until], end_id)
            ids.append(found)
            sizes.append(size)
            begin = until
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    def encode_batch(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; a null text counts as empty."""
        ids, limits = self.encode_column(pa.array(texts, pa.large_string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(limits, limits[1:], strict=False)]

    def _encode_some(self, texts: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.any(pc.match_substring_regex(texts, ODD)).as_py()
        chunks = pc.split_pattern_regex(texts, CUT) if odd else pc.utf8_split_whitespace(texts)
        limits = chunks.offsets.to_numpy().astype(np.int64)
        coded = chunks.values[limits[0] : limits[-1]].dictionary_encode()
        slots = self._slots(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        limits -= limits[0]
        size = self.table.size[slots]
        begin = self.table.begin[slots]
        pool = self.table.pool
        if end_id is not None:
            pool = np.append(pool[: self.table.used], np.uint32(end_id))
            size, begin = np.insert(size, limits[1:], 1), np.insert(begin, limits[1:], len(pool) - 1)
            limits += np.arange(len(limits))
        total = np.concatenate([[0], np.cumsum(size)])
        return _gather(pool, begin, size), np.diff(total[limits])

    def _slots(self, distinct: Sequence[str]) -> np.ndarray:
        """The places of chunks in the table; those that it does not hold come from the older one, or are learned."""
        slots = list(map(self.table.slots.get, distinct))
        gaps = [i for i, x in enumerate(slots) if x is None]
        if gaps and len(self.table) + len(gaps) > self.kept and len(self.table) > 1:
            # The older half goes, and so does a table that one group of texts alone has made too large.
            self.older, self.table = self.table if len(self.table) <= self.kept else Chunks(), Chunks()
            slots = list(map(self.table.slots.get, distinct))
            gaps = [i for i, x in enumerate(slots) if x is None]
        table, older = self.table, self.older
        if gaps:
            new = [distinct[i] for i in gaps]
            known = np.array([-1 if (x := older.slots.get(c)) is None else x for c in new], np.int64)
            there = known >= 0
            first = len(table.slots)
            if there.any():
                old = known[there]
                table.add([c for c, t in zip(new, there.tolist(), strict=True) if t], _gather(older.pool, older.begin[old], older.size[old]), older.size[old])
            fresh = [c for c, t in zip(new, there.tolist(), strict=True) if not t]
            table.add(fresh, *self.learn(fresh))
            rank = np.where(there, np.cumsum(there) - 1, there.sum() + np.cumsum(~there) - 1)
            for i, x in zip(gaps, (first + rank).tolist(), strict=True):
                slots[i] = x
        return np.array(slots, np.int64)

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by one space, special tokens included, as a file without a decoder has it."""
        return " ".join([self.tokens[i] for i in ids])


_loaded: dict[str, Vocabulary] = {}


def load(path: str) -> Vocabulary:
    """The vocabulary of this process: Python workers serve many tasks, so the file is read once in each."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id and ids (binary, little-endian unsigned 32-bit numbers).

    Whole texts are encoded, each in one task without a shuffle.  A null or empty text, or one of white
    space only, has no ids.  Null ids and repeated rows pass through; other columns are not read.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(vocabulary)
        for batch in batches:
            ids, limits = v.encode_column(batch.column(1))
            raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(limits, limits[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["_id", "ids"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["_id"], T.StructField("ids", T.BinaryType())])).withColumnRenamed("_id", id_col)


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``df``: id and text, the tokens of the ids joined by one space; null ids give an empty text."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(vocabulary)
        for batch in batches:
            texts = [v.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["_id", "text"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    return rows.mapInArrow(run, T.StructType([rows.schema["_id"], T.StructField("text", T.StringType())])).withColumnRenamed("_id", id_col)


def round_trip_digests(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass, as digests: id, n_tokens, ids_sha256 and decoded_sha256.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the decoded text in UTF-8.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(vocabulary)
        names = [v.tokens.get(i, "") for i in range(max(v.tokens) + 1)]
        decimal, token = (pa.array([f" {x}" for x in of], pa.large_string()) for of in (range(len(names)), names))

        def digests(of: pa.Array, ids: np.ndarray, limits: np.ndarray) -> Iterator[str]:
            """Of each text's values, joined by one space: each value has one before it, the first one's is left out."""
            begin = 0
            while begin < len(limits) - 1:  # about a million values at a time
                until = max(begin + 1, int(np.searchsorted(limits, limits[begin] + 1_000_000)) - 1)
                data, offsets = _bytes_of(of.take(pa.array(ids[limits[begin] : limits[until]])))
                at = offsets[limits[begin : until + 1] - limits[begin]].tolist()
                yield from (hashlib.sha256(data[a + 1 : b]).hexdigest() for a, b in zip(at, at[1:], strict=False))
                begin = until

        for batch in batches:
            found, limits = v.encode_column(batch.column(1))
            counts, ids, texts = np.diff(limits), list(digests(decimal, found, limits)), list(digests(token, found, limits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids), pa.array(texts)], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    schema = T.StructType([rows.schema["_id"], *T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string").fields])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
