"""Byte-level BPE encoding and decoding by forced borders (operator 11).

Every merge of a byte-level BPE makes a vocabulary token, so a pair of adjacent
bytes that occurs inside no token can never come to lie inside one: the place
between them is a certain cut.  A text is cut at all such places and where the
pre-tokenizer starts a piece; the fragments are encoded one by one, each distinct
fragment of a slice once, and their ids are concatenated.  Equal fragments are
found by Arrow's exact dictionary encoding, not by hashes.

The pre-tokenizer's pieces (contractions, an optional space and a run of
letters, digits or other characters, white space) follow from the class of each
code point and are computed for a whole slice at once.  Which class a code point
has depends on the Unicode version of the tokenizers library, so its own
``ByteLevel`` pre-tokenizer is asked, once for each code point that occurs.

Decoding looks up the bytes of each id; bytes that are no UTF-8 become U+FFFD.

Defined results: a null or empty text has no ids, null or empty ids give the
empty text; special tokens of the file are found in the text as the library
does; repeated rows, ties and null ids of rows do not matter, each row is worked on
by itself; an empty table gives an empty result; other columns are not read.
Ids outside the vocabulary decode to nothing.  A text is one piece of work of one
task, its memory is a small multiple of the longest text.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import slices

MAX_FILE = 64 << 20          # bytes of a vocabulary file, which every worker holds
CACHED = 200_000             # fragments that a worker remembers; beyond, it starts anew
LONG = 64                    # bytes of a fragment that are merged with a heap and not remembered
LETTER, DIGIT, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")      # contractions behind an apostrophe


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files:
    printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    table = {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Codec:
    """A byte-level BPE vocabulary, its cuts and its merges."""

    def __init__(self, file: bytes):
        j = json.loads(file)
        model, pre = j["model"], j.get("pre_tokenizer") or {}
        plain = not (j.get("normalizer") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix")
                     or model.get("ignore_merges") or pre.get("add_prefix_space"))
        added = j.get("added_tokens") or []
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or not plain \
                or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("only plain byte-level BPE files are supported")
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        vocab = model["vocab"]
        self.single = np.array([vocab[s] for s in symbols], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.new = np.array([vocab[a + b] for a, b in merges] + [0], np.int32)      # by rank; the last is for no merge
        self.special = {a["content"].encode(): a["id"] for a in added if a["content"]}
        self.find_special = re.compile(b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))).search
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.width = size
        key = np.array([vocab[a] * size + vocab[b] for a, b in merges] + [-1], np.int64)
        self.pairs, self.rank = np.unique(key, return_index=True)
        self.merges = {(vocab[a], vocab[b]): r for r, (a, b) in reversed([*enumerate(merges)])}
        tokens = [b""] * size
        self.inside = np.zeros(1 << 16, bool)       # byte pairs that some token holds
        for s, i in vocab.items():
            tokens[i] = t = bytes(back[c] for c in s)
            u = np.frombuffer(t, np.uint8).astype(np.int64)
            self.inside[u[:-1] * 256 + u[1:]] = True
        for t, i in self.special.items():
            tokens[i] = t
        self.length = np.array([len(t) for t in tokens] + [0], np.int64)     # the last is for ids outside
        self.place = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.known: dict[bytes, list[int]] = {}

    # -- pieces ---------------------------------------------------------------

    def _classify(self, points: np.ndarray) -> np.ndarray:
        c = self.classes[points]
        if (c == UNKNOWN).any():
            from tokenizers import pre_tokenizers
            split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
            new = np.unique(points[c == UNKNOWN])
            found = np.full(len(new), SPACE, np.uint8)
            for kind, head in ((LETTER, "a"), (DIGIT, "1"), (OTHER, "!")):      # joined with its like, apart from all others
                starts = np.array([at[0] for _, at in split("".join(f"{head}{chr(p)}\n" for p in new.tolist()))])
                found[~np.isin(np.arange(len(new)) * 3 + 1, starts)] = kind
            self.classes[new] = found
            c = self.classes[points]
        return c

    def _pieces(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether each code point starts a piece; ``first``: of a section."""
        n = len(points)
        c = self._classify(points)
        start = first.copy()
        start[1:] |= c[1:] != c[:-1]
        # the last of several blanks goes with what follows, if it is a space
        then = np.flatnonzero((c[1:] != SPACE) & (c[:-1] == SPACE) & ~first[1:]) + 1
        start[then - 1] = True
        start[then[points[then - 1] == 0x20]] = False
        # contractions
        quote = np.flatnonzero((points == 0x27) & start)
        far = np.concatenate([points, np.zeros(3, points.dtype)])
        edge = np.concatenate([first, np.ones(3, bool)])
        one = np.isin(far[quote + 1], [ord(x) for x in ONE_LETTER]) & ~edge[quote + 1]
        two = np.zeros(len(quote), bool)
        for a, b in TWO_LETTERS:
            two |= (far[quote + 1] == ord(a)) & (far[quote + 2] == ord(b))
        two &= ~edge[quote + 1] & ~edge[quote + 2]
        ends = np.concatenate([quote[one] + 2, quote[two] + 3])
        start[np.concatenate([quote[one] + 1, quote[two] + 1, quote[two] + 2])] = False
        start[ends[ends < n]] = True
        return start

    def cuts(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Sorted byte offsets at which the fragments of some texts start."""
        n = len(buf)
        data = buf.tobytes()
        cut = np.zeros(n + 1, bool)
        cut[offs] = True
        held = []
        if self.special:
            m = self.find_special(data)
            while m:
                p, q = m.span()
                whole = np.searchsorted(offs, p, "right") == np.searchsorted(offs, q - 1, "right")     # in one text
                held += [(p, q)] if whole else []
                m = self.find_special(data, q if whole else p + 1)
        for p, q in held:
            cut[[p, q]] = True
        at = np.flatnonzero((buf & 0xC0) != 0x80)
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        start = self._pieces(points, cut[at])
        cut[at[start]] = True
        u = buf.astype(np.int32)
        cut[1:n] |= ~self.inside[u[:-1] * 256 + u[1:]]
        for p, q in held:
            cut[p + 1:q] = False
        return np.flatnonzero(cut[:n])

    # -- ids ------------------------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; ``len(self.new)`` where there is no merge."""
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], len(self.new))

    def _merge(self, fragments: list[bytes]) -> list[list[int]]:
        """Ids of all fragments; each round merges the best pair of each (the
        leftmost of equal ones), fragments without one are done."""
        size = np.array([len(f) for f in fragments])
        sym = self.single[np.frombuffer(b"".join(fragments), np.uint8)]
        owner = np.repeat(np.arange(len(fragments)), size)
        none = len(self.new)
        rank = np.full(len(sym), none)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        rank[inner] = self._ranks(sym[inner], sym[inner + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            head = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, head)
            each = np.repeat(best, np.diff(np.append(head, len(sym))))
            if (best == none).any():
                over = each == none
                done.append((owner[over], sym[over]))
                sym, owner, rank, each = sym[~over], owner[~over], rank[~over], each[~over]
                continue
            at = np.flatnonzero(rank == each)
            at = at[np.concatenate([[True], owner[at[1:]] != owner[at[:-1]]])]
            sym[at] = self.new[rank[at]]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, owner, rank = sym[stay], owner[stay], rank[stay]
            at -= np.arange(len(at))
            for left in (at[at > 0] - 1, at):
                right = np.minimum(left + 1, len(sym) - 1)
                rank[left] = np.where((owner[left] == owner[right]) & (right > left), self._ranks(sym[left], sym[right]), none)
        owner = np.concatenate([o for o, _ in done])
        order = np.argsort(owner, kind="stable")
        ids = np.concatenate([i for _, i in done])[order].tolist()
        ends = np.cumsum(np.bincount(owner, minlength=len(fragments))).tolist()
        return [ids[p:q] for p, q in zip([0, *ends], ends)]

    def _merge_long(self, fragment: bytes) -> list[int]:
        """The same with a heap and linked neighbours: n log n."""
        ids = self.single[np.frombuffer(fragment, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(self.merges[p], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.new[self.merges[a, b]]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (ids[x], ids[y]) in self.merges:
                    heapq.heappush(heap, (self.merges[ids[x], ids[y]], x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def fragments(self, distinct: list[bytes]) -> list[list[int]]:
        """Ids of each of some distinct fragments; short ones are remembered."""
        new = [f for f in distinct if len(f) <= LONG and f not in self.known]
        if len(self.known) + len(new) > CACHED:
            self.known = {}
            new = [f for f in distinct if len(f) <= LONG]
        plain = [f for f in new if f not in self.special]
        self.known |= {f: [i] for f, i in self.special.items()}
        self.known |= zip(plain, self._merge(plain)) if plain else {}
        return [self.known[f] if f in self.known else self._merge_long(f) for f in distinct]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of texts given as bytes and offsets."""
        if not len(buf):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        start = self.cuts(buf, offs)
        ends = np.append(start, len(buf)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf))]).dictionary_encode()
        per = self.fragments(coded.dictionary.to_pylist())
        size = np.array([len(p) for p in per], np.int64)
        flat = np.array([i for p in per for i in p], np.int32)
        which = coded.indices.to_numpy()
        ids, ends = gather(flat, np.cumsum(size) - size, size, which)
        return ids, ends[np.searchsorted(start, offs)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(bytes, offsets)`` of the tokens."""
        which = np.where((ids >= 0) & (ids < len(self.length) - 1), ids, len(self.length) - 1)
        return gather(self.bytes, self.place, self.length, which)


def gather(flat: np.ndarray, place: np.ndarray, size: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``flat[place[w]:place[w] + size[w]]`` for all ``w`` of
    ``which``, one behind the other, and their offsets."""
    n = size[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(ends[-1]) + np.repeat(place[which] - ends[:-1], n)
    return flat[at], ends


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec of a broadcast file; one worker holds one."""
    if shared.id not in _codecs:
        _codecs.clear()
        _codecs[shared.id] = Codec(shared.value)
    return _codecs[shared.id]


class _Shared:
    """A broadcast vocabulary file and its number."""

    def __init__(self, spark: SparkSession, path: str):
        if os.path.getsize(path) > MAX_FILE:
            raise ValueError(f"a vocabulary file has at most {MAX_FILE} bytes")
        with open(path, "rb") as f:
            data = f.read()
        Codec(data)                                  # refuses other kinds before any task runs
        self.file = spark.sparkContext.broadcast(data)
        self.id = hash(data)

    @property
    def value(self) -> bytes:
        return self.file.value


def _texts(column: pa.Array) -> pa.Array:
    """The column as valid UTF-8 (U+FFFD for what is not)."""
    try:
        column.validate(full=True)
        return column
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.large_binary()).to_pylist()], pa.large_string())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids)``: the token ids of every text, by the vocabulary file at
    ``path`` (read by the driver and sent to the tasks)."""
    shared = _Shared(docs.sparkSession, path)
    d = docs.select(id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for lo, hi, buf, offs in slices(_texts(batch.column(1))):
                ids, ends = codec.encode(buf, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))],
                                                 names=[id_col, "ids"])

    return d.mapInArrow(run, f"`{id_col}` {d.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids as ``out``."""
    shared = _Shared(encoded.sparkSession, path)
    names = [*encoded.columns, out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                lists = part.column(ids_col)
                ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
                data, place = codec.decode(ids)
                n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = place[np.concatenate([[0], np.cumsum(n)])]
                raw = data.tobytes()
                text = pa.Array.from_buffers(pa.large_string(), len(part), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(text).cast(pa.string())], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{fields}, `{out}` string")


def report(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every row."""
    d = decode(encode(docs, path), path)
    return d.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                    F.sha2("decoded", 256).alias("decoded_sha256"))
