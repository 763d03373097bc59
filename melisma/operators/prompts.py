"""Prompts to typed clauses with their places in the text.

A prompt's words are rows. Runs of up to LONGEST words meet the lexicon in a join, whatever its size; of overlapping matches the leftmost stay, and of these
the longest. Each word that acts (a negation, a strength, a stage, an alternative) is an event, and what holds at a term is the last event before it in its
sentence: one window each. Unknown words become names where a word that introduces names, a negated list or a stage says so.
Text between quotation marks is one word that means nothing but itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intent import GROUPS, LEAST, MOST, NOUNS, PLAIN, TENS, TIMES, UNITS, masked, measured
from ..functions.lexicon import LONGEST

#: Unknown words in a row after which a negation, strength or stage no longer holds, and words of a name.
FORGET, NAME_WORDS = 3, 4
#: A quoted text; a word; a number with what is written onto it. What lies between two of these is a gap.
_QUOTED = r"\"[^\"]+\"|“[^”]+”"
PIECE = rf"({_QUOTED}|\p{{L}}[\p{{L}}\p{{N}}\p{{M}}'’&.-]*[\p{{L}}\p{{N}}]|\p{{L}}|\p{{N}}+(?:['’]?\p{{L}}+)?|[^\p{{L}}\p{{N}}\"“]+|[\"“])"
# What a year follows that a release is dated by, what parts two years, and ends of ordinal numbers.
DATED, PARTS, ORDINALS = ["released", "recorded", "composed", "written", "made"], ["to", "and", "through", "until"], ["st", "nd", "rd", "th"]
#: Words of numbers are no names.
_NUMBERS = [*UNITS, *TENS, *GROUPS, *TIMES, *NOUNS]


def tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, i, word (lower case; a mark for quoted text), surface, start, stop (characters), gap (what stands before it)."""
    p = df.select(key, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PIECE), F.lit(1))).alias("at", "piece"))
    at = Window.partitionBy(key).orderBy("at")
    size, is_word, quoted = F.char_length("piece"), r"[\p{L}\p{N}]", rf"^(?:{_QUOTED})$"
    p = p.select(key, "at", "piece", (F.sum(size).over(at) - size).cast("int").alias("start"), F.sum(size).over(at).cast("int").alias("stop"), F.lag("piece").over(at).alias("before"))
    p = p.filter(F.col("piece").rlike(is_word)).withColumn("quoted", F.col("piece").rlike(quoted))
    gap = F.when(F.col("before").rlike(is_word), "").otherwise(F.coalesce("before", F.lit("")))
    inner = F.col("quoted").cast("int")
    word = F.when(F.col("quoted"), '"').otherwise(F.translate(F.lower("piece"), "’", "'"))
    surface = F.when(F.col("quoted"), F.substring("piece", F.lit(2), size - 2)).otherwise(F.col("piece"))
    return p.select(key, (F.row_number().over(at) - 1).alias("i"), word.alias("word"), surface.alias("surface"), (F.col("start") + inner).alias("start"), (F.col("stop") - inner).alias("stop"), gap.alias("gap"))


def _year(x: Column) -> Column:
    n = F.when(x.rlike(r"^\d{4}$"), x.cast("int"))
    return F.when(n.between(1000, 2999), n)


def periods(words: DataFrame, key: str) -> DataFrame:
    """key, i, n, stop, kind, concept, role: decades, centuries, ranges of years and dated years as `first:last`."""
    w = Window.partitionBy(key).orderBy("i")
    ahead = lambda c, k: F.lead(c, k).over(w)
    digits, rest = F.regexp_extract("word", r"^(\d+)(.*)$", 1), F.regexp_extract("word", r"^(\d+)(.*)$", 2)
    number = F.when(F.char_length(digits).between(1, 4), digits.cast("int"))
    own = _year(F.col("word"))
    found = F.array(
        F.when(rest.isin("s", "'s") & (number % 10 == 0) & number.between(1500, 2990), F.struct(F.lit(1).alias("n"), number.alias("a"), (number + 9).alias("b"))),
        F.when(rest.isin(*ORDINALS) & number.between(1, 29) & (ahead("word", 1) == "century"), F.struct(F.lit(2).alias("n"), ((number - 1) * 100 + 1).alias("a"), (number * 100).alias("b"))),
        F.when(ahead("gap", 1).isin("-", "–") & (own <= _year(ahead("word", 1))), F.struct(F.lit(2).alias("n"), own.alias("a"), _year(ahead("word", 1)).alias("b"))),
        F.when(ahead("word", 1).isin(*PARTS) & (own <= _year(ahead("word", 2))), F.struct(F.lit(3).alias("n"), own.alias("a"), _year(ahead("word", 2)).alias("b"))),
        F.when((F.lag("word").over(w) == "in") & F.lag("word", 2).over(w).isin(*DATED), F.struct(F.lit(1).alias("n"), own.alias("a"), own.alias("b"))),
    )
    best = F.array_max(F.filter(found, lambda x: x["a"].isNotNull()))
    p = words.select(key, "i", best.alias("p"), *(ahead("stop", k).alias(f"stop{k}") for k in range(3))).filter("p is not null")
    stop = F.get(F.array("stop0", "stop1", "stop2"), F.col("p.n") - 1)
    return p.select(key, "i", F.col("p.n").alias("n"), stop.alias("stop"), F.lit("period").alias("kind"), F.concat_ws(":", F.col("p.a").cast("string"), F.col("p.b").cast("string")).alias("concept"), F.lit(None).cast("string").alias("role"))


def matches(words: DataFrame, lexicon: DataFrame, key: str) -> DataFrame:
    """key, i, n, stop, kind, concept, role: lexicon phrases and periods, leftmost first and then longest, none over another. A phrase goes over no mark that ends a clause."""
    w = Window.partitionBy(key).orderBy("i")
    whole, phrases = F.lit(True), []
    for n in range(1, LONGEST + 1):
        if n > 1:
            whole = whole & ~F.lead("gap", n - 1).over(w).rlike(r"[,.;:!?\n()\"“”]")
        phrases.append(F.when(whole, F.struct(F.lit(n).alias("n"), F.concat_ws(" ", *(F.lead("word", k).over(w) for k in range(n))).alias("phrase"), F.lead("stop", n - 1).over(w).alias("stop"))))
    # Whoever stands at the end has no further word, and so no further phrase.
    runs = words.select(key, "i", F.array(*phrases).alias("runs")).select(key, "i", F.explode(F.filter("runs", lambda x: x["stop"].isNotNull())).alias("r")).select(key, "i", "r.*")
    found = runs.join(lexicon, "phrase").select(key, "i", "n", "stop", "kind", "concept", "role").unionByName(periods(words, key))
    best = found.groupBy(key, "i").agg(F.max(F.struct("n", "kind", "concept", "role", "stop")).alias("m"))
    listed = best.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("all"))  # of one prompt
    free = F.aggregate("all", F.struct(F.lit(0).alias("to"), F.filter("all", lambda x: F.lit(False)).alias("kept")), lambda s, x: F.when(x["i"] >= s["to"], F.struct((x["i"] + x["m"]["n"]).alias("to"), F.concat(s["kept"], F.array(x)).alias("kept"))).otherwise(s), lambda s: s["kept"])
    return listed.select(key, F.explode(free).alias("x")).select(key, "x.i", "x.m.*")


def atoms(df: DataFrame, lexicon: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """key, kind, value, concept, polarity, strength, scope, choice, start, stop: what a prompt says, each with the characters that say it.

    Kinds are the lexicon's, `period`, and for names `artist`, `include`, `exclude` and, at stages, `start`, `via` and `destination`. polarity is positive or negative; strength is required, essential or preferred; scope is playlist or a
    part of a journey; terms that `or` joins have one number as their choice. key tells prompts apart. A null or empty prompt has no atoms, nor has an empty table. Positions count characters from 0.
    """
    words = tokens(df, key, text)
    m = matches(words, lexicon, key).select(key, "i", "n", F.col("stop").alias("m_stop"), "kind", "concept", "role")
    w = Window.partitionBy(key).orderBy("i")
    t = words.join(m, [key, "i"], "left")
    # Words within a match belong to its first one.
    reach = F.max(F.col("i") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    heads = t.withColumn("inside", F.coalesce(F.col("n").isNull() & (F.col("i") < reach), F.lit(False)))
    phrase = F.when(F.col("n") > 1, F.concat_ws(" ", *(F.when(F.col("n") > k, F.lead("word", k).over(w)) for k in range(LONGEST)))).otherwise(F.col("word"))
    heads = heads.withColumn("phrase", phrase).filter(~F.col("inside")).withColumn("stop", F.coalesce("m_stop", "stop"))
    heads = heads.withColumn("sentence", F.sum(F.col("gap").rlike(r"[.;:!?\n]").cast("int")).over(w)).withColumn("comma", F.col("gap").contains(","))
    # `of` and `the` between capitals belong to a name.
    capital = lambda x: x.rlike(r"^\p{Lu}") & (F.col("word") != '"')
    inside = F.col("word").isin("of", "the") & capital(F.lag("surface").over(w)) & capital(F.lead("surface").over(w)) & (F.col("gap") == " ")
    heads = heads.withColumn("role", F.when(~F.coalesce(inside, F.lit(False)), F.col("role")))
    heads = heads.withColumn("plain", F.col("role").isNull() & F.col("kind").isNull())
    s = Window.partitionBy(key, "sentence").orderBy("i")
    before, upto, after = s.rowsBetween(Window.unboundedPreceding, -1), s.rowsBetween(Window.unboundedPreceding, 0), s.rowsBetween(1, Window.unboundedFollowing)
    role, nexts, last = F.col("role"), F.lead("kind").over(s), F.lag("role").over(s)
    dated = F.coalesce(nexts == "period", F.lit(False))
    # From and to are stages only together, and not where years follow.
    real = F.when((role == "from") & ~dated & (F.max((role == "to").cast("int")).over(after) == 1), "start").when((role == "to") & ~dated & (F.max(role.isin("from", "start").cast("int")).over(before) == 1), "end").when(role == "to", "stop").when(role == "from", "filler").otherwise(role)
    heads = heads.withColumn("role", real)
    # How many unknown words there have been in a row.
    turn = F.max(F.when(~F.col("plain"), F.col("i"))).over(upto)
    role, forget = F.col("role"), F.col("plain") & (F.col("i") - F.coalesce(turn, F.min("i").over(s.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) - 1) >= FORGET)
    stage = role.isin("start", "via", "end")
    turns = F.when(role == "negative", "-").when(role == "reduced", "less").when(role.isin("positive", "contrast", "like", "by", "include") | stage | forget, "+")
    amount = F.when(role.isin("soft", "strict"), role).when(turns.isNotNull(), "plain")
    place = F.when(role == "start", "journey_start").when(role == "via", "journey_via").when(role == "end", "journey_end").when(F.col("comma") | forget, "playlist")
    names = F.when(role.isin("like", "by", "include"), role).when(role.isin("negative", "reduced", "contrast", "positive", "stop") | stage | forget, "none")
    holds = lambda event, window, otherwise: F.coalesce(F.last(event, ignorenulls=True).over(window), F.lit(otherwise))
    # A comma ends a stage for the very word behind it.
    heads = heads.select("*", holds(turns, before, "+").alias("sign"), holds(amount, before, "plain").alias("amount"), holds(F.when(~stage | role.isNull(), place).otherwise(place), upto, "playlist").alias("scope"), holds(names, before, "none").alias("mode"), last.alias("last_role"))
    a = _named(heads, key, s)
    negative = F.col("sign") != "+"
    sign = F.when(negative, "negative").otherwise("positive")
    strength = F.when(F.col("sign") == "less", "preferred").when(negative, "required").when(F.col("amount") == "strict", "required").when(F.col("amount") == "soft", "preferred").when(F.col("kind") == "period", "required").when(F.col("kind") == "genre", "essential").otherwise("preferred")
    energy = F.col("kind") == "energy"
    a = a.select(
        key, "i", "kind", "value", F.when(energy, F.split_part("concept", F.lit(":"), F.lit(2))).otherwise(F.col("concept")).alias("concept"), sign.alias("polarity"), strength.alias("strength"),
        F.when(energy, F.split_part("concept", F.lit(":"), F.lit(1))).otherwise(F.col("scope")).alias("scope"), "start", "stop", "chained",
    )
    # A chain begins where no `or` leads to a term.
    chain = F.sum((~F.col("chained")).cast("int")).over(w)
    a = a.withColumn("chain", chain)
    many = (F.count(F.lit(1)).over(Window.partitionBy(key, "chain")) > 1) & (F.min("polarity").over(Window.partitionBy(key, "chain")) == "positive")
    return a.withColumn("choice", F.when(many, F.col("chain"))).select(key, "kind", "value", "concept", "polarity", "strength", "scope", "choice", "start", "stop")


def _named(heads: DataFrame, key: str, s) -> DataFrame:
    """Terms and names: i, kind, value, concept, start, stop, chained (whether `or` joins it to the one before)."""
    quoted = F.col("word") == '"'
    capital = F.col("surface").rlike(r"^\p{Lu}")
    number = F.col("word").rlike(r"^\d") | F.col("word").isin(*_NUMBERS)
    # After `by` even a musical term is a name.
    free = (F.col("plain") & ~number) | ((F.col("mode") == "by") & F.col("kind").isNotNull() & (F.col("kind") != "period"))
    heads = heads.withColumn("free", free)
    breaks = ~(F.col("free") & F.coalesce(F.lag("free").over(s), F.lit(False))) | F.col("comma") | quoted | F.coalesce(F.lag("word").over(s) == '"', F.lit(False))
    heads = heads.withColumn("run", F.sum(breaks.cast("int")).over(s))
    r = Window.partitionBy(key, "sentence", "run")
    inner = r.orderBy("i")
    heads = heads.select(
        "*", F.count(F.lit(1)).over(r).alias("words"), F.max(capital.cast("int")).over(r).alias("capital"), F.row_number().over(inner).alias("nth"), F.max("stop").over(r).alias("run_stop"),
        F.concat_ws(" ", F.collect_list("surface").over(inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("name"), F.max("i").over(r).alias("run_last"),
    )
    # What follows the run, as its first word sees it: the first word behind it.
    behind = F.struct(F.lead("kind").over(s).alias("kind"), F.lead("role").over(s).alias("role"), F.lead("comma").over(s).alias("comma"), F.lead("i").over(s).alias("i"), F.lead("start").over(s).alias("start"))
    heads = heads.withColumn("next", behind).withColumn("behind", F.last("next").over(inner.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    joins = F.col("last_role").isin("and", "or", "negative")
    free_end = F.col("behind.i").isNull() | F.col("behind.comma") | F.coalesce(F.col("behind.role").isNotNull(), F.lit(False))
    open_end = free_end | F.col("behind.kind").isNull()
    staged = (F.col("scope") != "playlist") & (F.col("last_role").isin("start", "via", "end", "and", "filler"))
    introduced = F.col("mode").isin("like", "by", "include") & (F.col("last_role").isin("like", "by", "include", "and", "or") | F.col("comma") | ((F.col("last_role") == "filler") & (F.col("capital") == 1)))
    listed = (F.col("sign") == "-") & (joins | F.col("comma") | (F.col("last_role") == "filler")) & ((F.col("capital") == 1) | ((F.col("words") <= 2) & ((F.col("last_role") != "negative") | F.coalesce(F.col("behind.role").isin("or", "and") | F.col("behind.comma"), F.lit(False))) & F.coalesce(free_end, F.lit(True))))
    is_name = F.col("free") & (F.col("nth") == 1) & (F.col("words") <= NAME_WORDS) & F.coalesce(open_end, F.lit(True)) & (introduced | listed | (staged & (F.col("capital") == 1)))
    is_name = F.coalesce(is_name, F.lit(False)) | (quoted & (F.col("mode").isin("like", "by", "include") | (F.col("sign") == "-") | (F.col("scope") != "playlist")))
    heads = heads.withColumn("is_name", is_name)
    in_name = F.col("free") & (F.max(F.col("is_name").cast("int")).over(r) == 1)
    # One unknown word right before a voice, an instrument or a texture belongs to it: harsh vocals.
    lone = F.lag(F.struct("plain", "words", "start", "surface", "is_name", "word")).over(s)
    qualified = F.col("kind").isin("vocal", "instrument", "texture") & ~F.col("comma") & lone["plain"] & (lone["words"] == 1) & ~lone["is_name"] & ~lone["word"].rlike(r'^[\d"]')
    qualified = F.coalesce(qualified, F.lit(False))
    name_kind = F.when(F.col("sign") == "-", "exclude").when(F.col("mode") == "include", "include").when(F.col("mode").isin("like", "by"), "artist").when(F.col("scope") == "journey_start", "start").when(F.col("scope") == "journey_end", "destination").when(F.col("scope") == "journey_via", "via").otherwise("artist")
    kept = heads.withColumn("in_name", in_name).withColumn("qualified", qualified).withColumn("q_start", lone["start"]).withColumn("q_word", lone["surface"]).withColumn("name_kind", name_kind)
    kept = kept.withColumn("two_back", F.lag(F.col("kind").isNotNull() | F.col("in_name"), 2).over(s)).withColumn("three_back", F.lag(F.col("kind").isNotNull(), 3).over(s))
    back = F.when(F.col("qualified"), F.lag("last_role").over(s)).otherwise(F.col("last_role"))
    reached = F.when(F.col("qualified"), F.col("three_back")).otherwise(F.col("two_back"))
    kept = kept.withColumn("chained", F.coalesce((back == "or") & reached, F.lit(False)))
    term = F.col("kind").isNotNull() & ~F.col("in_name")
    kept = kept.filter(term | F.col("is_name"))
    value = F.when(F.col("is_name"), F.col("name")).when(F.col("qualified"), F.concat_ws(" ", F.lower("q_word"), "phrase")).otherwise(F.col("phrase"))
    return kept.select(
        key, "i", F.when(F.col("is_name"), F.col("name_kind")).otherwise(F.col("kind")).alias("kind"), value.alias("value"), F.when(~F.col("is_name"), F.col("concept")).alias("concept"), "sign", "amount", "scope",
        F.when(~F.col("is_name") & F.col("qualified"), F.col("q_start")).otherwise(F.col("start")).alias("start"), F.when(F.col("is_name"), F.col("run_stop")).otherwise(F.col("stop")).alias("stop"), "chained",
    )


def intents(df: DataFrame, lexicon: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """One row a prompt: key, mode, track_count, explicit_count, duration_seconds, least_seconds, references, inclusions, exclusions, alternatives, stages, periods and energy.

    A null prompt asks for nothing: a list of the usual length. Lists keep the order of the prompt, each entry once.
    """
    a = atoms(df, lexicon, key, text)
    kind, staged, good = F.col("kind"), F.col("scope") != "playlist", F.col("polarity") == "positive"
    entry = lambda when, value: F.collect_list(F.when(when, F.struct("start", value.alias("x"))))
    stage = F.when(kind.isin("start", "via", "destination") | (staged & good & kind.isin("genre", "style", "mood")), F.struct(F.when(F.col("scope") == "journey_start", 0).when(F.col("scope") == "journey_via", 1).otherwise(2).alias("order"), "start", F.col("value").alias("x")))
    period = F.struct(F.split_part("concept", F.lit(":"), F.lit(1)).cast("int").alias("first"), F.split_part("concept", F.lit(":"), F.lit(2)).cast("int").alias("last"), (~good).alias("negative"))
    lists = a.groupBy(key).agg(
        entry((kind == "artist") & good, F.col("value")).alias("references"), entry((kind == "include") & good, F.col("value")).alias("inclusions"), entry(~good & (kind != "period"), F.col("value")).alias("exclusions"),
        F.collect_list(stage).alias("stages"), entry(kind == "period", period).alias("periods"), entry(kind == "energy", F.struct("scope", F.col("concept").cast("double").alias("value"))).alias("energy"),
        F.collect_list(F.when(F.col("choice").isNotNull(), F.struct("choice", "start", "value"))).alias("choices"),
    )
    ordered = lambda c: F.array_distinct(F.transform(F.sort_array(c), lambda x: x["x"])).alias(c)
    of_choice = F.transform(F.array_distinct(F.transform(F.sort_array("choices"), lambda x: x["choice"])), lambda c: F.transform(F.filter(F.sort_array("choices"), lambda x: x["choice"] == c), lambda x: x["value"]))
    said = df.select(key, measured(masked(F.coalesce(F.col(text), F.lit("")))).alias("m"))
    r = said.join(lists.select(key, *map(ordered, ("references", "inclusions", "exclusions", "stages", "periods", "energy")), of_choice.alias("alternatives")), key, "left")
    none = lambda c: F.coalesce(F.col(c), F.array().cast(r.schema[c].dataType)).alias(c)
    return r.select(
        key, F.when(F.size("stages") > 0, "journey").otherwise("similar").alias("mode"), F.greatest(F.lit(LEAST), F.least(F.lit(MOST), F.coalesce("m.count", F.lit(PLAIN)))).alias("track_count"), F.col("m.count").isNotNull().alias("explicit_count"),
        F.when(F.col("m.seconds") > 0, F.col("m.seconds")).alias("duration_seconds"), F.col("m.least_seconds").alias("least_seconds"), *map(none, ("references", "inclusions", "exclusions", "alternatives", "stages", "periods", "energy")),
    )


#: What a prompt alone decides, whatever a model says.
OWNED = ["count", "duration", "energy"]


def judged(model: DataFrame, said: DataFrame, prompts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """The rows of model (key, kind, value, polarity, strength, scope, evidence) with start, stop and a verdict.

    Evidence that stands in the prompt exactly once has a place there. A clause is
    `owned` if only the prompt decides its kind; `confirmed` if an atom at its place says the same, `contradicted` if atoms there say otherwise; `invented` if it dates music by what the prompt has nowhere; `kept` if the prompt says nothing about it.
    """
    evidence, prompt = F.lower(F.col("m.evidence")), F.lower(F.coalesce(F.col(f"p.{text}"), F.lit("")))
    once = (F.col("m.evidence") != "") & ((F.char_length(prompt) - F.char_length(F.replace(prompt, evidence, F.lit("")))) == F.char_length(evidence))
    placed = model.withColumn("clause", F.monotonically_increasing_id()).alias("m").join(prompts.select(key, text).alias("p"), key, "left")
    start = F.when(once, F.expr(f"locate(lower(m.evidence), lower(p.`{text}`)) - 1"))
    placed = placed.select("m.*", start.alias("start")).withColumn("stop", F.col("start") + F.char_length("evidence"))
    a = said.select(F.col(key).alias("k"), F.struct("kind", "value", "polarity").alias("atom"), F.col("start").alias("from"), F.col("stop").alias("to"))
    met = placed.join(a, (placed[key] == a["k"]) & (placed["start"] < a["to"]) & (placed["stop"] > a["from"]), "left")
    contains = lambda x, y: F.contains(F.lower(x), F.lower(y))
    same = (F.col("atom.kind") == F.col("kind")) & (F.col("atom.polarity") == F.col("polarity")) & (contains("atom.value", F.col("value")) | contains("value", F.col("atom.value")))
    columns = [*model.columns, "start", "stop"]
    found = met.groupBy("clause", *columns).agg(F.count("atom").alias("atoms"), F.coalesce(F.max(same.cast("int")), F.lit(0)).alias("same"))
    verdict = F.when(F.col("kind").isin(*OWNED), "owned").when(F.col("same") == 1, "confirmed").when(F.col("atoms") > 0, "contradicted").when((F.col("kind") == "period") & F.col("start").isNull(), "invented").otherwise("kept")
    return found.select(*columns, verdict.alias("verdict"))


def reconciled(model: DataFrame, said: DataFrame, prompts: DataFrame, key: str = "key", text: str = "text") -> DataFrame:
    """key, kind, value, polarity, strength, scope, origin: all atoms, and of a model's clauses those that no atom decides. What no text of the prompt backs is preferred at most."""
    kept = judged(model, said, prompts, key, text).filter("verdict = 'kept'")
    soft = F.when(F.col("start").isNull(), "preferred").otherwise(F.col("strength"))
    columns = [key, "kind", "value", "polarity"]
    return said.select(*columns, "strength", "scope", F.lit("prompt").alias("origin")).unionByName(kept.select(*columns, soft.alias("strength"), "scope", F.lit("model").alias("origin")))


# What a clause may be.
KINDS = ["genre", "style", "mood", "instrument", "vocal", "texture", "activity", "energy", "period", "artist", "recording", "include", "exclude", "start", "via", "destination"]
POLARITIES, STRENGTHS, SCOPES = ["positive", "negative"], ["required", "essential", "preferred"], ["playlist", "journey_start", "journey_via", "journey_end"]
#: Terms that one choice may have.
MOST_CHOICES = 100


def clause_problems(clauses: DataFrame, key: str = "key") -> DataFrame:
    """key and problems, sorted, for each prompt of clauses (key, kind, value, polarity, strength, scope, choice) that has any: of a clause by itself, and of clauses that can't hold together."""
    first, last = (F.split_part("value", F.lit(":"), F.lit(k)).cast("int") for k in (1, 2))
    period = F.col("kind") == "period"
    dated = F.when(F.col("value").rlike(r"^\d{1,4}:\d{1,4}$"), (first >= 1) & (first <= last)).otherwise(F.lit(False))
    rules = [
        (~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown kind"), (F.trim(F.coalesce("value", F.lit(""))) == "", "empty value"), (~F.coalesce(F.col("polarity").isin(*POLARITIES), F.lit(False)), "unknown polarity"),
        (~F.coalesce(F.col("strength").isin(*STRENGTHS), F.lit(False)), "unknown strength"), (~F.coalesce(F.col("scope").isin(*SCOPES), F.lit(False)), "unknown scope"), (F.coalesce(period & ~dated, F.lit(False)), "period is no range of years"),
        (F.col("kind").isin("include", "start", "via", "destination") & (F.col("polarity") == "negative"), "a wanted name is refused"), (F.col("choice").isNotNull() & ~F.coalesce((F.col("polarity") == "positive") & (F.col("scope") == "playlist"), F.lit(False)), "a choice is refused or of a stage"),
    ]
    own = clauses.select(key, F.explode(F.filter(F.array(*(F.when(wrong, what) for wrong, what in rules)), lambda x: x.isNotNull())).alias("problem"))
    name = F.lower("value")
    both = clauses.filter(F.col("kind").isin("include", "exclude", "artist")).groupBy(key, name.alias("name")).agg(F.max((F.col("kind") == "exclude").cast("int")).alias("out"), F.max((F.col("kind") == "include").cast("int")).alias("in"))
    both = both.filter((F.col("out") == 1) & (F.col("in") == 1)).select(key, F.lit("a name is both wanted and refused").alias("problem"))
    many = clauses.filter("choice is not null").groupBy(key, "choice").count().filter(F.col("count") > MOST_CHOICES).select(key, F.lit("a choice is too wide").alias("problem"))
    return own.unionByName(both).unionByName(many).groupBy(key).agg(F.sort_array(F.collect_set("problem")).alias("problems"))


def single_genre(clauses: DataFrame, key: str = "key") -> DataFrame:
    """key and genre, for prompts that ask one genre or style of every track: one wanted for the whole playlist, no other, none as a choice and none of a stage. What is only preferred asks nothing."""
    asked = clauses.filter(F.col("kind").isin("genre", "style") & (F.col("polarity") == "positive") & (F.col("strength") != "preferred") & (F.trim("value") != ""))
    apart = F.max((F.col("choice").isNotNull() | (F.col("scope") != "playlist")).cast("int"))
    one = asked.groupBy(key).agg(F.count_distinct(F.lower("value")).alias("n"), F.min(F.lower("value")).alias("genre"), apart.alias("apart"))
    return one.filter("n = 1 and apart = 0").select(key, "genre")
