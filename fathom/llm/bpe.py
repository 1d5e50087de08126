"""Byte-level BPE by dynamic programming over prefixes, with exact appends and local re-encoding after edits."""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.runtime import bounded_batches, text_or_empty

#: What a worker remembers, about 130 bytes each: ids of pieces, of which the older half goes when there are more; pairs of
#: tokens that may be neighbours or not; and histories of tokens' borders.
REMEMBERED, REMEMBERED_PAIRS, REMEMBERED_CHAINS = 300_000, 300_000, 30_000


class Vocabulary:
    """Ranks of byte strings, and whether two tokens may stand beside each other.

    Two neighbouring tokens are what BPE makes of their joined bytes exactly if, undoing the merges that face the
    border from the latest to the earliest, no merge across the border would have come before the one undone. An
    encoding is right exactly if all its neighbours may stand beside each other, so each prefix has one valid last
    token: the one that may follow the last token of the shorter prefix before it.
    """

    def __init__(self, ranks: dict[bytes, int]):
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.bytes_of = {v: k for k, v in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._chains: dict[tuple[int, int], list[tuple[int, bytes]]] = {}
        #: Whether two tokens may stand beside each other, by left << 32 | right, as far as was asked.
        self.known: dict[int, bool] = {}
        #: Finds the tokens that merging makes wherever they end, longest first (texts as one character per byte); a found
        #: token comes as token << shift | length. Other tokens can never end a prefix.
        self.shift = self.longest.bit_length()
        self.ends = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for data, token in ranks.items():
            if self.reachable(token):
                self.ends.add_word(data.decode("latin-1"), token << self.shift | len(data))
        self.ends.make_automaton()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(k): int(v) for k, v in (line.split() for line in f if line.strip())})

    def merged(self, data: bytes, below: int | None = None) -> list[int]:
        """Plain BPE: merge the lowest-ranked neighbours, leftmost first, while their rank is under `below`."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)))
            if rank >= (1 << 60 if below is None else below):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge made this one; None for a byte or a token that merging never makes."""
        if token not in self._halves:
            data = self.bytes_of[token]
            parts = self.merged(data, below=token) if len(data) > 1 else []
            self._halves[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._halves[token]

    def reachable(self, token: int) -> bool:
        return len(self.bytes_of[token]) == 1 or self.halves(token) is not None

    def beside(self, left: int, right: int) -> bool:
        key = left << 32 | right
        known = self.known.get(key)
        if known is None:
            if len(self.known) >= REMEMBERED_PAIRS:
                self.known.clear()
            known = self.known[key] = self._check(left, right)
        return known

    def _check(self, left: int, right: int) -> bool:
        # Walk back through the history of the border. A token is made at its rank's turn (a byte is there from the
        # start); until_left and until_right are the turns at which the facing tokens were consumed by their own side.
        ranks, lefts, rights = self.ranks, self._chain(left, 1), self._chain(right, 0)
        i = j = 0
        until_left = until_right = 1 << 60
        while True:
            (l, left_bytes), (r, right_bytes) = lefts[i], rights[j]
            joint = ranks.get(left_bytes + right_bytes)
            # The joint merge happens if its turn comes before both facing tokens are consumed. A tie on the left goes to
            # the left merge (it stands further left), one on the right to the joint merge.
            if joint is not None and joint < until_left and joint <= until_right:
                return False
            left_made = l if i + 1 < len(lefts) else -1
            right_made = r if j + 1 < len(rights) else -1
            if left_made < 0 and right_made < 0:
                return True
            # Undo the later one; of equal ranks the right one came later.
            if right_made >= left_made:
                until_right, j = right_made, j + 1
            else:
                until_left, i = left_made, i + 1

    def _chain(self, token: int, side: int) -> list[tuple[int, bytes]]:
        """The token, its half on that side, the half's half, down to a byte."""
        chain = self._chains.get((token, side))
        if chain is None:
            if len(self._chains) >= REMEMBERED_CHAINS:
                self._chains.clear()
            chain = [(token, self.bytes_of[token])]
            while len(chain[-1][1]) > 1:
                half = self.halves(chain[-1][0])[side]
                chain.append((half, self.bytes_of[half]))
            self._chains[token, side] = chain
        return chain


class PrefixEncoder:
    """The encoding of one byte string, kept as the valid last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, bytearray(), [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Add bytes at the end; the tokens of all former prefixes stay as they are."""
        v, last, old = self.v, self.last, len(self.data)
        self.data += more
        known, beside, shift, size = v.known.get, v.beside, v.shift, (1 << v.shift) - 1
        last += [None] * len(more)
        begin = max(0, old - v.longest)
        for end, found in v.ends.iter(self.data[begin:].decode("latin-1")):
            end += begin + 1
            # Of the tokens that may end a prefix only one fits behind the token before it, so the first found is it.
            if last[end] is None:
                before = last[end - (found & size)]
                found >>= shift
                if before >= 0:
                    fits = known(before << 32 | found)
                    if fits is None:
                        fits = beside(before, found)
                    if not fits:
                        continue
                last[end] = found

    def edit(self, at: int, removed: int, added: bytes) -> None:
        """Replace data[at:at + removed]; only prefixes that end behind `at` are computed anew, up to where the old tokens meet again."""
        tail, old = bytes(self.data[at + removed :]), self.last[at + removed :]
        del self.data[at:], self.last[at + 1 :]
        self.append(added)
        done = 0
        same = 0
        while done < len(tail):
            self.append(tail[done : done + 1])
            done += 1
            # A prefix's token depends on the tokens of the `longest` prefixes before it and on the bytes alone: once so
            # many in a row are as before, all that follow are.
            same = same + 1 if self.last[-1] == old[done] else 0
            if same >= self.v.longest:
                self.data += tail[done:]
                self.last += old[done + 1 :]
                break

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end])
            end -= len(self.v.bytes_of[out[-1]])
        return out[::-1]


class _Pieces(dict):
    """int32 ids of a piece of text, as bytes; made when first asked for."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.v, self.older = vocabulary, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            data = piece.encode()
            whole = self.v.ranks.get(data)
            ids = [whole] if whole is not None else PrefixEncoder(self.v, data).ids()
            out = np.array(ids, dtype="<i4").tobytes()
        if len(self) >= REMEMBERED // 2:
            self.older = dict(self)
            self.clear()
        if len(piece) <= 64:
            self[piece] = out
        return out


#: Texts of these characters alone (ASCII and Latin-1 letters) are split by the standard library's faster engine.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_CLASSES = {r"\p{L}": "A-Za-zÀ-ÖØ-öø-ÿ", r"\p{N}": "0-9"}


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern over plain texts, its letter and number classes spelt out; None if the standard library cannot read it."""
    out, inside, i = "", False, 0
    while i < len(pattern):
        part = next((k for k in _CLASSES if pattern.startswith(k, i)), None)
        if part:
            out += _CLASSES[part] if inside else f"[{_CLASSES[part]}]"
        else:
            part = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
            inside = (inside or part == "[") and part != "]"
            out += part
        i += len(part)
    if r"\p" in out or r"\P" in out:
        return None
    try:
        return re.compile(out)
    except re.error:
        return None


class Decoder:
    """Ids to bytes, from two arrays."""

    def __init__(self, bytes_of: dict[int, bytes]):
        top = max(bytes_of) + 1
        self.sizes = np.array([len(bytes_of.get(k, b"")) for k in range(top)], "i8")
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.flat = np.frombuffer(b"".join(bytes_of.get(k, b"") for k in range(top)), "u1")

    def decode(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begins[ids] - (ends - sizes), sizes)
        return self.flat[at + np.arange(ends[-1])].tobytes()


class Tokenizer(Decoder):
    """Text to ids and back: each match of `pattern` is encoded by itself, without special tokens."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        super().__init__(vocabulary.bytes_of)
        self.v, self.split_any, self.pieces = vocabulary, regex.compile(pattern).findall, _Pieces(vocabulary)
        plain = plain_pattern(pattern)
        self.split_plain = plain.findall if plain else None

    def split(self, text: str) -> list[str]:
        return self.split_plain(text) if self.split_plain and _PLAIN.fullmatch(text) else self.split_any(text)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split(text))), "<i4")


def _read_ranks(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(k): int(v) for k, v in (x.split() for x in ranks.splitlines() if x.strip())}


#: What a worker has open: one tokenizer or decoder at a time.
_OPEN: dict[tuple, Decoder] = {}


def _opened(key: tuple, make: Callable[[], Decoder]) -> Decoder:
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = make()
    return _OPEN[key]


def _tokenizer(ranks: bytes, path: str, pattern: str) -> Tokenizer:
    return _opened((path, pattern), lambda: Tokenizer(Vocabulary(_read_ranks(ranks)), pattern))


#: Bytes of text and ids that one Arrow batch of results holds, about, but for single longer rows.
BATCH_BYTES = 4 << 20


def _id_lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype("i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.empty(0, "i4")))


def _encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, text_col: str, back: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)
    ranks = _broadcast_ranks(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(ranks.value, ranks_path, pattern)
        for batch in batches:
            names, out, decoded, size, first = batch.column(0), [], [], 0, 0
            for i, text in enumerate(batch.column(1)):
                out.append(tok.encode(text.as_py()))
                size += out[-1].nbytes
                if back:
                    decoded.append(tok.decode(out[-1]))
                    size += len(decoded[-1])
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    cols = {id_col: names.slice(first, len(out)), "ids": _id_lists(out)}
                    if back:
                        cols["decoded"] = pa.array(decoded, pa.binary())
                    yield pa.RecordBatch.from_pydict(cols)
                    out, decoded, size, first = [], [], 0, i + 1

    rows = docs.select(id_col, text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, ids array<int>" + ", decoded binary" * back)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids array<int>): the text's tokens, as many rows as came in. Null texts count as empty and have no ids.

    The rank file is read on the driver and broadcast (a vocabulary: under 10 MB, whatever the size of the corpus).
    Each task encodes its rows as they stream by; nothing is shuffled.
    """
    return _encoded(docs, ranks_path, pattern, id_col, text_col, False)


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, ids, decoded binary): the bytes that the ids stand for. Null ids count as none. The decoder is two arrays."""
    bounded_batches(encoded.sparkSession)
    ranks = _broadcast_ranks(encoded, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_of = lambda: {v: k for k, v in _read_ranks(ranks.value).items()}
        decoder = _opened((ranks_path,), lambda: Decoder(bytes_of()))
        for batch in batches:
            ids, out, size, first = batch.column(1), [], 0, 0
            for i, x in enumerate(ids):
                out.append(decoder.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"")
                size += len(out[-1])
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(out)), ids.slice(first, len(out)), pa.array(out, pa.binary())], names=[id_col, "ids", "decoded"])
                    out, size, first = [], 0, i + 1

    rows = encoded.select(id_col, F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, ids array<int>, decoded binary")


def _broadcast_ranks(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids, decoded): encoding, then decoding of the ids it gave, in one pass through one worker per task."""
    return _encoded(docs, ranks_path, pattern, id_col, text_col, True)
