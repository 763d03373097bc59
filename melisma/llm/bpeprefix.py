"""Byte-level BPE by dynamic programming over prefixes.

Merging bytes by rank gives every byte string one encoding, and each prefix of it one too. The last token of a prefix's encoding is the one
token that ends there, follows the last token of what is before it, and stays apart from that one when their bytes are merged
together. So one pass stores the last token of each prefix, from which the encoding is read backwards. The table holds for any
longer string too: bytes that are appended only add to it, and after an edit only entries from its start on are made anew, until
as many of them as a token has bytes agree with the old ones.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import kernels as K
from .store import column, tables, whole

#: Encoded pieces that a worker remembers, in two halves of which the older one goes when the newer one is full, and pairs of tokens; when there are more of these it begins anew.
KEPT_PIECES, KEPT_PAIRS = 400_000, 1_000_000
#: Characters of texts that are encoded together. Pieces of a longer text are taken one by one, and never stand in a list; pieces of more characters than PIECE are not remembered.
LONG, PIECE = 1 << 20, 64
#: Bytes of ids that a batch of results holds, about.
BATCH_BYTES = 1 << 23
NONE = -1


def default_vocabulary() -> tuple[str, str]:
    """Path of the ranks, and the pattern of pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@functools.lru_cache(2)
def tokens_of(content: bytes) -> dict[int, bytes]:
    """Tokens by id, of a file of ranks; all that decoding needs."""
    return {int(b): base64.b64decode(a) for a, b in map(bytes.split, content.splitlines())}


def decode_ids(ids: bytes, tokens: dict[int, bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Vocabulary:
    """Tokens by rank, as a file of ranks has them; an automaton that tells which tokens end at each byte; and what tells which two tokens stay apart."""

    def __init__(self, content: bytes) -> None:
        self.tokens = tokens_of(content)
        self.ranks = {t: r for r, t in self.tokens.items()}
        self.longest = max(map(len, self.ranks), default=1)
        self.halves: dict[int, tuple[int, int]] = {}  # the two tokens that a token's last merge joins
        self.steps: dict[int, int] = {}  # a trie of the tokens: node << 8 | byte -> next node
        spelt: list[int] = [NONE]  # the token that a node spells
        for token, rank in self.ranks.items():
            if len(token) > 1:
                parts = self._merged(token)
                if len(parts) != 2:  # merging never gives this token; only a piece that is equal to it does
                    continue
                self.halves[rank] = parts[0], parts[1]
            node = 0
            for byte in token:
                step = self.steps.setdefault(node << 8 | byte, len(spelt))
                if step == len(spelt):
                    spelt.append(NONE)
                node = step
            spelt[node] = rank
        # Where to go on when no token goes on from a node: the longest suffix of what it spells that begins a token.
        self.shorter = [0] * len(spelt)
        #: (token, bytes) of all tokens that end where a node is reached, the longest first, which is most often the one.
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(spelt)
        level = [(0, 0)]
        below: dict[int, list[tuple[int, int]]] = {}
        for key, to in self.steps.items():
            below.setdefault(key >> 8, []).append((key & 255, to))
        depth = 0
        while level:
            for node, _ in level:
                if node:
                    own = ((spelt[node], depth),) if spelt[node] != NONE else ()
                    self.ending[node] = own + self.ending[self.shorter[node]]
                for byte, to in below.get(node, ()):
                    back = self.shorter[node] if node else NONE
                    while back != NONE and back << 8 | byte not in self.steps:
                        back = self.shorter[back] if back else NONE
                    self.shorter[to] = self.steps[back << 8 | byte] if back != NONE else 0
            level, depth = [x for node, _ in level for x in ((to, byte) for byte, to in below.get(node, ()))], depth + 1
        self._apart: dict[int, bool] = {}

    def _merged(self, token: bytes) -> list[int]:
        """What is left of a token's bytes before its last merge: two tokens, if merging by rank ends in the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            found = min(((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1])) is not None), default=None)
            if found is None:
                break
            parts[found[1] : found[1] + 2] = [parts[found[1]] + parts[found[1] + 1]]
        return [self.ranks[p] for p in parts]

    def apart(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b together gives a and b again.

        Looked at backwards in time: both are whole at first, and the part made last is undone each time. They stay apart if no merge over the border had
        its turn while its two parts were there. Of two merges of one rank the left one goes first.
        """
        key = a << 32 | b
        if (known := self._apart.get(key)) is not None:
            return known
        x, y, x_until, y_until, out = a, b, 1 << 62, 1 << 62, True
        while True:
            merged = self.ranks.get(self.tokens[x] + self.tokens[y])
            if merged is not None and merged < x_until and merged <= y_until:
                out = False
                break
            x_parts, y_parts = self.halves.get(x), self.halves.get(y)
            if y_parts and (y >= x or not x_parts):
                y_until, y = y, y_parts[0]
            elif x_parts:
                x_until, x = x, x_parts[1]
            else:
                break
        if len(self._apart) >= KEPT_PAIRS:
            self._apart.clear()
        self._apart[key] = out
        return out

    def read_back(self, last: list[int]) -> list[int]:
        """The encoding that a table of last tokens holds."""
        out, i, tokens = [], len(last) - 1, self.tokens
        while i:
            token = last[i]
            out.append(token)
            i -= len(tokens[token])
        return out[::-1]

    def extend(self, data: bytes, last: list[int], nodes: list[int]) -> None:
        """Adds to last the token that ends each longer prefix, and to nodes the automaton's node there, given those of the shorter ones."""
        steps, shorter, ending, known, i, node = self.steps, self.shorter, self.ending, self._apart, len(last), nodes[-1]
        for byte in data:
            while (to := steps.get(node << 8 | byte)) is None:
                if not node:
                    raise ValueError("the vocabulary has no token for a byte")
                node = shorter[node]
            node = to
            nodes.append(node)
            for token, size in ending[node]:
                if size < i:
                    before = last[i - size]
                    if (apart := known.get(before << 32 | token)) is None:
                        apart = self.apart(before, token)
                    if not apart:
                        continue
                last.append(token)
                break
            i += 1


class Prefixes:
    """The encodings of all prefixes of a piece: last[i] ends that of its first i bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last, self._nodes = vocabulary, bytearray(), [NONE], [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.vocabulary.extend(more, self.last, self._nodes)

    def cut(self, size: int) -> None:
        """Keeps the first `size` bytes."""
        del self.data[size:], self.last[size + 1 :], self._nodes[size + 1 :]

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Puts new in place of the bytes from start to end; gives the number of entries that were made anew. What follows keeps its entries as soon as all that a token can reach agree."""
        last, nodes, shift, settled, longest = self.last, self._nodes, len(new) - (end - start), start + len(new), self.vocabulary.longest
        data = bytes(self.data[:start]) + new + bytes(self.data[end:])
        rest, self.last, self._nodes, same = data[start:], last[: start + 1], nodes[: start + 1], 0
        self.data = bytearray(data)
        for k in range(len(rest)):
            self.vocabulary.extend(rest[k : k + 1], self.last, self._nodes)
            i = start + 1 + k
            same = same + 1 if i > settled and last[i - shift] == self.last[i] and nodes[i - shift] == self._nodes[i] else 0
            if same >= longest:
                self.last += last[i - shift + 1 :]
                self._nodes += nodes[i - shift + 1 :]
                return k + 1
        return len(rest)

    def ids(self) -> list[int]:
        return self.vocabulary.read_back(self.last)


class Pieces:
    """The pieces into which a pattern cuts texts, as tiktoken cuts them."""

    # Letters, numbers and white space up to U+024F, for which the standard module, which is twice as fast, cuts as this pattern does.
    LATIN = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0"}

    def __init__(self, pattern: str) -> None:
        # White space as Unicode lists it; \s of either module has the separators 1C to 1F too.
        self.any = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}"))
        latin = pattern.replace(r"\S", r"[^\s]")
        for name, characters in self.LATIN.items():
            latin = re.sub(r"\[\^[^]]*\]", lambda m, n=name, c=characters: m[0].replace(n, c), latin)
            latin = re.sub(re.escape(name), lambda m, c=characters: f"[{c}]", latin)
        self.latin, self.beyond = re.compile(latin), re.compile("[^\x00-\u024f\u2010-\u2027\u20ac]")
        # Characters that Unicode has taken in lately count as what tiktoken takes them for: its tables may be older than the pattern module's.
        import tiktoken

        pairs = [bytes([a, b]) for a in b"a1!" for b in range(256)]
        asked = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate([*(bytes([b]) for b in range(256)), *pairs])}, special_tokens={})
        unknown = "".join(c for c in map(chr, range(0xA0, 0x110000)) if unicodedata.category(c) == "Cn")
        self.stand_ins = {}
        for pattern_of, mine in ((r"\p{L}", "\xe9"), (r"\p{N}", "\xb2")):
            for c in regex.findall(pattern_of, unknown):
                theirs = next((k for first, k in (("a", "\xe9"), ("1", "\xb2")) if asked.encode_ordinary(first + c)[0] > 255), "\ue000")
                if theirs != mine:
                    self.stand_ins[ord(c)] = theirs
        self.lately = regex.compile("[" + "".join(map(chr, self.stand_ins)) + "]") if self.stand_ins else None

    def spans(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        standing = text.translate(self.stand_ins) if self.lately and self.lately.search(text) else text
        return (m.span() for m in self.any.finditer(standing, start))

    def __call__(self, text: str) -> Iterator[str] | list[str]:
        if not self.beyond.search(text):
            return self.latin.findall(text) if len(text) < LONG else (m[0] for m in self.latin.finditer(text))
        if self.lately and self.lately.search(text):
            pieces = (text[a:b] for a, b in self.spans(text))
            return list(pieces) if len(text) < LONG else pieces
        return self.any.findall(text) if len(text) < LONG else (m[0] for m in self.any.finditer(text))


class Encoder:
    """Encodes texts piece by piece; ids are little-endian unsigned 32-bit numbers."""

    def __init__(self, content: bytes, pattern: str) -> None:
        self.vocabulary, self.pieces = Vocabulary(content), Pieces(pattern)
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def learn(self, new: set[str]) -> None:
        """Encodes pieces. In byte order each begins as the one before does, and only appends to what is left of its table."""
        table, at = Prefixes(self.vocabulary), b""
        for data, piece in sorted((p.encode(), p) for p in new):
            if (code := self._older.get(piece)) is None:
                if (rank := self.vocabulary.ranks.get(data)) is not None:
                    code = struct.pack("<I", rank)
                else:
                    n, most = 0, min(len(at), len(data))
                    while n < most and at[n] == data[n]:
                        n += 1
                    table.cut(n)
                    table.append(data[n:])
                    at = data
                    ids = self.vocabulary.read_back(table.last)
                    code = struct.pack(f"<{len(ids)}I", *ids)
            self._known[piece] = code

    def joined(self, found: list[list[str]]) -> list[bytes]:
        """Lists of pieces, each one's ids together."""
        known = self._known
        new = set().union(*found).difference(known)
        self.learn(new)
        out = [b"".join(map(known.__getitem__, pieces)) for pieces in found]
        for piece in new:
            if len(piece) > PIECE:
                del known[piece]
        if len(known) > KEPT_PIECES // 2:
            self._known, self._older = {}, known
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text; texts of about LONG characters are encoded together."""
        some, size = [], 0
        for text in texts:
            if len(text) >= LONG:
                yield from self.joined(some)
                some, size = [], 0
                pieces = iter(self.pieces(text))
                yield b"".join(iter(lambda p=pieces: self.joined([list(itertools.islice(p, 50_000))])[0], b""))
                continue
            some.append(self.pieces(text))
            size += len(text)
            if size >= LONG:
                yield from self.joined(some)
                some, size = [], 0
        yield from self.joined(some)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


class Edited:
    """A text with the encoding of each of its pieces, for appends and edits: only pieces near a change are found and encoded again."""

    def __init__(self, encoder: Encoder, text: str = "") -> None:
        self.encoder, self.text = encoder, text
        self.ends: list[int] = []
        self.codes: list[bytes] = []
        self._split(0, 0, None)

    def _split(self, keep: int, settled: int, old: tuple[list[int], list[bytes], int] | None) -> int:
        """Pieces from the end of the first `keep` on, until one ends at `settled` or later where an old one did, from where the old ones hold; gives the number of pieces found."""
        found = 0
        then = {end + old[2]: i for i, end in enumerate(old[0])} if old else {}
        del self.ends[keep:], self.codes[keep:]
        for begin, end in self.encoder.pieces.spans(self.text, self.ends[-1] if self.ends else 0):
            found += 1
            self.ends.append(end)
            self.codes.append(self.encoder.joined([[self.text[begin:end]]])[0])
            if end >= settled and end in then:
                i = then[end] + 1
                self.ends += [e + old[2] for e in old[0][i:]]
                self.codes += old[1][i:]
                break
        return found

    def edit(self, start: int, end: int, new: str) -> int:
        """Puts new in place of the characters from start to end; gives the number of pieces found again. A piece depends on two characters behind it at most."""
        old = self.ends[:], self.codes[:], len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        return self._split(int(np.searchsorted(self.ends, start - 2, "right")), start + len(new), old)

    def append(self, more: str) -> int:
        return self.edit(len(self.text), len(self.text), more)

    def ids(self) -> bytes:
        return b"".join(self.codes)


@functools.lru_cache(2)
def encoder_of(content: bytes, pattern: str) -> Encoder:
    """A worker's own; it serves all tasks that the worker gets."""
    return Encoder(content, pattern)


def batches_of(batch: pa.RecordBatch, made: Iterator[bytes], name: str) -> Iterator[pa.RecordBatch]:
    """The rows of a batch with one more binary column, in batches of bounded size."""
    first, held, size = 0, [], 0
    for value in made:
        held.append(value)
        size += len(value)
        if size >= BATCH_BYTES or first + len(held) == batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array(held, pa.binary())], names=[batch.schema.names[0], name])
            first, held, size = first + len(held), [], 0


@K.tidy
def encoded(batches: Iterator[pa.RecordBatch], sent, pattern: str) -> Iterator[pa.RecordBatch]:
    encoder = encoder_of(sent.value, pattern)
    for batch in batches:
        yield from batches_of(pa.RecordBatch.from_arrays([batch.column(0)], names=["row"]), encoder.encode_all(t.as_py() or "" for t in batch.column(1)), "ids")


@K.tidy
def decoded(batches: Iterator[pa.RecordBatch], sent, pattern: str) -> Iterator[pa.RecordBatch]:
    tokens = tokens_of(sent.value)
    for batch in batches:
        yield from batches_of(pa.RecordBatch.from_arrays([batch.column(0)], names=["row"]), (decode_ids(x.as_py() or b"", tokens) for x in batch.column(1)), "decoded")


def _mapped(df: DataFrame, value: F.Column, f, name: str, vocabulary: str | None, pattern: str | None) -> DataFrame:
    path, own = default_vocabulary() if vocabulary is None or pattern is None else (vocabulary, pattern)
    with open(vocabulary or path, "rb") as file:
        sent = df.sparkSession.sparkContext.broadcast(file.read())  # a vocabulary: executors need no file of their own
    rows = whole(df).select("row", value.alias("value"))
    schema = StructType([rows.schema["row"], StructField(name, BinaryType())])
    return rows.mapInArrow(lambda x: f(x, sent, pattern or own), schema)


def encode(df: DataFrame, text_col: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """row (a row of df, whole) and ids, little-endian unsigned 32-bit, as tiktoken's encode_ordinary gives them; rows go one by one and stay where they are.

    A null or empty text has no ids. Repeated rows are encoded each. Other columns, of whatever name, are kept in row. An empty table gives no rows. A piece (a run of letters, say) of any length takes time and memory in proportion to it.
    """
    return _mapped(df, F.col("row").getField(text_col).cast("string"), encoded, "ids", vocabulary, pattern)


def decode(df: DataFrame, ids_col: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """row (a row of df, whole) and decoded, the bytes that the ids stand for; null ids give none. An id that the vocabulary lacks is an error."""
    return _mapped(df, F.col("row").getField(ids_col), decoded, "decoded", vocabulary, pattern)


def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(tables(spark, sf_dir, "documents").select(column("doc_id"), column("text"))).select("row.doc_id", "ids")
    n = (F.octet_length("row.ids") / 4).cast("long")
    return decode(ids).select("row.doc_id", n.alias("n_tokens"), F.sha2("row.ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
