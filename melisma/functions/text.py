"""Scalar functions on names, codes, dates and JSON, as column expressions. Only Unicode folding needs Python, and then by batches."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def identity_part(x: Column) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def recording_key(identity: Column, track_id: Column, artist: Column, title: Column) -> Column:
    """An explicit recording identity, else a local or pack id, else normalised artist and title."""
    return F.when(F.coalesce(identity, F.lit("")) != "", identity).when(track_id.rlike("^(local|pack):"), track_id).otherwise(F.concat_ws("\0", identity_part(artist), identity_part(title)))


def display_parts(x: Column) -> tuple[Column, Column]:
    """Artist and title of "Artist - Title", parted at the first dash; without one, no artist."""
    at = F.instr(x, " - ")
    return F.when(at > 0, F.trim(F.substring(x, F.lit(1), at - 1))).otherwise(F.lit("")), F.when(at > 0, F.trim(F.substring(x, at + 3, F.length(x)))).otherwise(F.trim(x))


def _fold(x: str | None, keep: re.Pattern) -> str | None:
    if x is None:
        return None
    y = "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn").lower()
    return keep.sub(" ", y).strip()


def _folded(x: Column, pattern: str) -> Column:
    keep = re.compile(pattern)
    fold = F.pandas_udf(lambda s: pd.Series([_fold(v, keep) for v in s]), StringType())
    return fold(x)


def latin_search(x: Column) -> Column:
    """Marks dropped, lower case, everything but a-z and 0-9 one space. Text in ASCII stays in the JVM."""
    return F.when(x.rlike(r"^[\x00-\x7F]*$"), F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))).otherwise(_folded(x, "[^a-z0-9]+"))


def unicode_search(x: Column) -> Column:
    """As latin_search, but letters and digits of every script stay."""
    return F.when(x.rlike(r"^[\x00-\x7F]*$"), F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))).otherwise(_folded(x, r"[\W_]+"))


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda t: t != "")


#: Words that a search leaves out only when it finds nothing with them, and words that don't count in semantic text.
FILLER = (
    "song", "songs", "track", "tracks", "tune", "tunes", "music", "stuff", "vibe", "vibes", "playlist", "mix", "like", "similar", "radio", "the", "a", "an", "some", "and", "by", "feat", "ft",
)
STOP = ("a", "an", "and", "but", "for", "in", "of", "or", "the", "to", "with")

#: Spellings of styles, and the styles that are kinds of another.
STYLES = {"ambient electronica": "ambient electronic", "rock and roll": "rock & roll", "rock n roll": "rock & roll", "rock roll": "rock & roll", "electronica": "electronic"}
STYLE_PARENTS = {
    "ambient electronic": "electronic", "techno": "electronic", "house": "electronic", "electro": "electronic", "idm": "electronic", "synthpop": "electronic", "drum and bass": "electronic", "downtempo": "electronic",
    "trance": "electronic", "rock & roll": "rock", "alternative rock": "rock", "indie rock": "rock", "hard rock": "rock", "dance-rock": "rock",
}


def canonical_style(x: Column) -> Column:
    y = identity_part(x)
    return F.coalesce(F.create_map(*(F.lit(v) for kv in STYLES.items() for v in kv))[y], y)


def style_matches(wanted: Column, actual: Column) -> Column:
    """A style matches itself and its kinds, but not the other way round."""
    w, a = canonical_style(wanted), canonical_style(actual)
    parent = F.create_map(*(F.lit(v) for kv in STYLE_PARENTS.items() for v in kv))
    return (w == a) | F.coalesce(parent[a] == w, F.lit(False))


def without_filler(toks: Column) -> Column:
    """All tokens that are not filler, repeats included; if none is left, all."""
    left = F.filter(toks, lambda t: ~t.isin(*FILLER))
    return F.when(F.size(left) > 0, left).otherwise(toks)


def semantic_tokens(x: Column, stop: tuple[str, ...] = STOP) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda t: ~t.isin(*stop))


def query_keys(toks: Column) -> Column:
    """The whole phrase, then word pairs, then words, each once."""
    n = F.size(toks)
    pairs = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(toks, i - 1), F.get(toks, i)))).otherwise(F.array().cast("array<string>"))
    return F.filter(F.array_distinct(F.concat(F.array(F.array_join(toks, " ")), pairs, toks)), lambda t: t != "")


def comparable(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]+", " "))


def isrc(x: Column) -> Column:
    y = F.upper(F.regexp_replace(x, r"[\s-]+", ""))
    return F.when(y.rlike(r"^[A-Z]{2}[A-Z0-9]{3}[0-9]{7}$"), y).otherwise(F.lit(""))


def uuid(x: Column) -> Column:
    y = F.lower(F.trim(x))
    return F.when(y.rlike(UUID), y).otherwise(F.lit(""))


def recording_identity(mbid: Column, isrc_: Column, acoustid: Column, fingerprint: Column, title: Column, artist: Column) -> Column:
    """The strongest identity there is: MBID, ISRC, AcoustID, or a hash of fingerprint and comparable names."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    hashed = F.substring(F.sha2(F.concat_ws("\0", fingerprint, comparable(artist), comparable(title)), 256), 1, 24)
    return F.when(has(mbid), F.concat(F.lit("mbid:"), mbid)).when(has(isrc_), F.concat(F.lit("isrc:"), isrc_)).when(has(acoustid), F.concat(F.lit("acoustid:"), acoustid)).when(has(fingerprint), F.concat(F.lit("fp:"), hashed))


def entity_id(kind: str, value: Column) -> Column:
    return F.concat(F.lit(kind + ":"), F.substring(F.sha2(F.concat(F.lit(kind + "\0"), identity_part(value)), 256), 1, 24))


def keyed_priority(seed: int, domain: str, x: Column) -> Column:
    """A hash that orders ids for sampling: of a version (a fixed value), the seed's 8 little-endian bytes, and, after a NUL each, the domain and the id. Hex sorts as bytes do."""
    head = b"keyed-artist-round-robin/v1" + (seed & (1 << 64) - 1).to_bytes(8, "little") + b"\0" + domain.encode() + b"\0"
    return F.sha2(F.concat(F.lit(bytearray(head)), x.cast("string").cast("binary")), 256)


def stable_hash(seed: int, x: Column) -> Column:
    """The first 8 bytes of a SHA-256 as a little-endian number, as 16 hex digits of the number."""
    h = F.sha2(F.concat(F.lit(f"{seed}\0"), x.cast("string")), 256)
    return F.concat(*(F.substring(h, 15 - 2 * k, 2) for k in range(8)))


def very_similar(a: Column, b: Column) -> Column:
    """Equal, or both of 8 characters or more and apart by at most a twentieth of the longer (1 at least)."""
    longest = F.greatest(F.length(a), F.length(b))
    most = F.greatest(F.lit(1), F.floor(longest / 20).cast("int"))
    return (a == b) | ((F.least(F.length(a), F.length(b)) >= 8) & (F.levenshtein(a, b) <= most))


def one_edit(a: Column, b: Column) -> Column:
    return (F.levenshtein(a, b) <= 1) & (F.substring(a, 1, 1) == F.substring(b, 1, 1))


def umlauts(x: Column) -> Column:
    for plain, spelt in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        x = F.replace(x, F.lit(plain), F.lit(spelt))
    return x


def year(x: Column) -> Column:
    return F.expr("1").cast("int") if x is None else F.substring(x, 1, 4).try_cast("int")


def decade(y: Column) -> Column:
    return (F.floor(y / 10) * 10).cast("int")


def share(total: Column, buckets: Column, i: Column) -> Column:
    """Slots of bucket i (from 0) when `total` are dealt to `buckets`, the first ones getting the rest."""
    return (F.floor(total / buckets) + F.when(i < F.pmod(total, buckets), 1).otherwise(0)).cast("long")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def audio_weight(audio: Column, track: Column) -> Column:
    return F.when(audio + track <= 0, F.lit(0.5)).otherwise(audio / (audio + track))


def signed_range(v: Column, low: float, high: float) -> Column:
    return 2 * clamp((v - low) / (high - low), 0.0, 1.0) - 1


def outside(ms: Column, target: Column, tolerance: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.abs(ms - target) - tolerance)


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the JSON of a struct of these columns, by name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
