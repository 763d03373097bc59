"""What prompts count and how long they want it, as column expressions, and checks of what was read from them.

Quoted text is masked first, so that words in a title never act as syntax. Numbers are read by one pass over a prompt's words that carries the number
met last and how many words ago it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of numbers, what is counted, and what is measured but is no count of tracks.
UNITS = {"zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
GROUPS = {"dozen": 12, "handful": 8, "few": 5, "hundred": 100}
NOUNS = ["song", "songs", "track", "tracks", "tune", "tunes", "piece", "pieces", "long"]
MEASURES = ["year", "years", "bpm", "decade", "decades", "artist", "artists", "album", "albums", "genre", "genres", "playlist", "playlists"]
TIMES = {"hour": 3600, "hours": 3600, "hr": 3600, "hrs": 3600, "minute": 60, "minutes": 60, "min": 60, "mins": 60, "second": 1, "seconds": 1, "sec": 1, "secs": 1}
LEAST, MOST, PLAIN = 1, 100, 20
#: Words between a number and what it counts.
BETWEEN = 4

# A character for private use: it stands for each character of quoted text.
HIDDEN = "\ue000"


def _map(values: dict[str, int], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def masked(prompt: Column) -> Column:
    """The prompt with every character between quotation marks hidden; lengths stay."""
    pieces = F.regexp_extract_all(prompt, F.lit(r"(\"[^\"]*\"|“[^”]*”|[^\"“]+|[\"“])"), F.lit(1))
    hidden = F.transform(pieces, lambda x: F.when(x.rlike(r"^[\"“].+[\"”]$"), F.concat(F.substring(x, 1, 1), F.repeat(F.lit(HIDDEN), F.char_length(x) - 2), F.substring(x, -1, 1))).otherwise(x))
    return F.array_join(hidden, "")


def words(text: Column) -> Column:
    """Lower-cased words; a hyphen after a number, or between words of a number, parts them."""
    low = F.regexp_replace(F.lower(text), r"(?<![\p{L}\p{N}-])(\d{1,9})\p{Pd}(?=(?:song|track|tune|piece|hour|hr|min|sec)[a-z]*\b)", "$1 ")
    low = F.regexp_replace(low, rf"\b({'|'.join(TENS)})\p{{Pd}}(?=(?:{'|'.join(UNITS)})\b)", "$1 ")
    low = F.regexp_replace(low, rf"\b({'|'.join([*UNITS, *TENS])})\p{{Pd}}(?=(?:song|track|tune|piece|hour|minute|second)s?\b)", "$1 ")
    return F.regexp_extract_all(low, F.lit(r"(\d{1,9}(?=\s?\p{Pd}\s?\d)|[\p{L}\p{N}](?:[\p{L}\p{N}\p{M}'’&.-]*[\p{L}\p{N}])?)"), F.lit(1))


def measured(text: Column) -> Column:
    """struct(count, seconds, least_seconds) of a masked prompt: the number that counts tracks last, the time asked for, and the lower end of a range of times; each null if it isn't said.

    One pass: `n` is the number met last, `age` the words since, `low` a number that it may be the upper end to, `part` whether a word of tens may still be added to.
    """
    start = F.struct(*(F.lit(None).cast("int").alias(c) for c in ("n", "low", "count", "seconds", "least")), F.lit(0).alias("age"), F.lit(False).alias("part"), F.lit("").alias("last"), F.lit("").alias("before"))

    def step(s: Column, w: Column) -> Column:
        unit, ten, group, time = _map(UNITS, w), _map(TENS, w), _map(GROUPS, w), _map(TIMES, w)
        digits = F.when(w.rlike(r"^\d{1,9}$"), w.cast("int"))
        refused = s["last"].isin("no", "not", "without")
        half = (s["last"] == "half") | ((s["last"].isin("a", "an")) & (s["before"] == "half"))
        grouped = F.when(group.isNotNull() & s["last"].isin("a", "one"), F.when(half, F.floor(group / 2).cast("int")).otherwise(group))
        number = F.when(unit.isNotNull() & s["part"] & (s["age"] == 0) & (unit < 10), s["n"] + unit).otherwise(F.coalesce(digits, unit, ten, grouped))
        number = F.when(~refused | s["part"], number)
        article = F.when(s["last"].isin("a", "an"), F.lit(1))
        amount = F.when(s["age"] == 0, s["n"])
        seconds = F.when(time.isNotNull(), F.when(half, F.floor(time / 2).cast("int")).otherwise(F.coalesce(amount, article) * time))
        half_more = (w == "half") & (s["last"] == "a") & (s["before"] == "and")
        counts = s["n"].isNotNull() & (s["age"] <= BETWEEN) & (w.isin(NOUNS) | ((w == "them") & (s["last"] == "of")))
        ends = time.isNotNull() | w.isin(MEASURES) | counts
        upper = number.isNotNull() & s["n"].isNotNull() & (s["age"] == 1) & s["last"].isin("to", "or", "and")
        upper = upper | (number.isNotNull() & s["n"].isNotNull() & (s["age"] == 0) & ~s["part"] & digits.isNotNull())
        spent = F.lit(None).cast("int")
        return F.struct(
            F.when(ends, spent).when(number.isNotNull(), number).when(s["age"] >= BETWEEN, spent).otherwise(s["n"]).alias("n"),
            F.when(upper, s["n"]).when(number.isNotNull() | ends, spent).otherwise(s["low"]).alias("low"),
            F.when(counts, s["n"]).otherwise(s["count"]).alias("count"),
            F.when(seconds.isNotNull(), F.coalesce(s["seconds"], F.lit(0)) + seconds).when(half_more & (s["seconds"] % 3600 == 0), s["seconds"] + 1800).otherwise(s["seconds"]).alias("seconds"),
            F.when(seconds.isNotNull() & s["low"].isNotNull() & (s["age"] == 0), s["low"] * time).otherwise(s["least"]).alias("least"),
            F.when(number.isNotNull() | ends, F.lit(0)).otherwise(s["age"] + 1).alias("age"),
            (ten.isNotNull() & number.isNotNull()).alias("part"),
            w.alias("last"),
            s["last"].alias("before"),
        )

    return F.aggregate(words(text), start, step, lambda s: F.struct(s["count"].alias("count"), s["seconds"].alias("seconds"), s["least"].alias("least_seconds")))


def problems(intent: Column) -> Column:
    """What is wrong with an intent; an empty array for a good one."""
    checks = [
        (~intent["track_count"].between(LEAST, MOST), "track_count is out of range"),
        (~intent["mode"].isin("similar", "journey"), "mode is unknown"),
        ((intent["mode"] == "journey") & (F.size(intent["stages"]) < 2), "a journey needs two stages"),
        (intent["duration_seconds"] <= 0, "duration isn't positive"),
        (F.arrays_overlap(intent["references"], intent["exclusions"]), "a reference is excluded"),
    ]
    return F.filter(F.array(*(F.when(F.coalesce(wrong, F.lit(False)), what) for wrong, what in checks)), lambda x: x.isNotNull())


def migrated(old: DataFrame) -> DataFrame:
    """Intents of an older form (count, seeds, avoid, duration) with the current columns added; the old ones go. Columns of the current form are kept where they are not null."""
    has = lambda name, kind: F.col(name) if name in old.columns else F.lit(None).cast(kind)
    count = F.coalesce(has("track_count", "int"), has("count", "int"))
    current = {
        "mode": F.when(has("mode", "string") == "journey", "journey").otherwise("similar"),
        "track_count": F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.coalesce(count, F.lit(PLAIN)))),
        "explicit_count": F.coalesce(has("explicit_count", "boolean"), has("count", "int").isNotNull()),
        "duration_seconds": F.coalesce(has("duration_seconds", "int"), has("duration", "int")),
        "references": F.coalesce(has("references", "array<string>"), has("seeds", "array<string>"), F.array().cast("array<string>")),
        "exclusions": F.coalesce(has("exclusions", "array<string>"), has("avoid", "array<string>"), F.array().cast("array<string>")),
        "stages": F.coalesce(has("stages", "array<string>"), F.array().cast("array<string>")),
    }
    rest = [c for c in old.columns if c not in current and c not in ("count", "seeds", "avoid", "duration")]
    return old.select(*rest, *(v.alias(k) for k, v in current.items()))
