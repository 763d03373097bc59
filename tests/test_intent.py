"""Prompts with what they ask for, held as rows."""

import pytest
from pyspark.sql import functions as F

from melisma.functions import intent as N
from melisma.functions import lexicon as L
from melisma.operators import prompts as P

PROMPTS = [
    # prompt, what must hold of its intent
    ("18 songs like Massive Attack and Air", {"track_count": 18, "explicit_count": True, "references": ["Massive Attack", "Air"], "mode": "similar"}),
    ("put something on", {"track_count": 20, "explicit_count": False, "references": [], "stages": [], "duration_seconds": None}),
    ("thirty two reggae songs", {"track_count": 32}),
    ("forty-one slow tracks", {"track_count": 41}),
    ("half a dozen tunes, thanks", {"track_count": 6}),
    ("a dozen quiet cello pieces", {"track_count": 12}),
    ("a few songs by Joni Mitchell", {"track_count": 5, "references": ["Joni Mitchell"]}),
    ("one hundred tracks", {"track_count": 100}),
    ("three artists and nine songs", {"track_count": 9}),
    ("16th century songs", {"explicit_count": False, "periods": [(1501, 1600, False)]}),
    ("2-step tunes", {"explicit_count": False}),
    ("A 9-song set like Boards of Canada: quiet piano, but don't play Boards of Canada themselves.", {"track_count": 9, "references": ["Boards of Canada"], "exclusions": ["Boards of Canada"]}),
    ("make it 12 long", {"track_count": 12}),
    ("I adore Portishead, so seven of them", {"track_count": 7}),
    ("11 songs, then 31 tracks", {"track_count": 31}),
    ('put "Nine Songs" on', {"explicit_count": False}),
    ("700 songs", {"track_count": 100, "explicit_count": True}),
    ("a 25-minute cycling mix", {"duration_seconds": 1500, "explicit_count": False}),
    ("an hour of trance", {"duration_seconds": 3600}),
    ("half an hour of trance", {"duration_seconds": 1800}),
    ("an hour and a half of ska", {"duration_seconds": 5400}),
    ("2 hours 5 minutes of disco", {"duration_seconds": 7500}),
    ("20 to 40 minutes of funk", {"duration_seconds": 2400, "least_seconds": 1200}),
    ("20-40 minutes of funk", {"duration_seconds": 2400, "least_seconds": 1200}),
    ("Techno but without any Orbital or leftfield", {"exclusions": ["Orbital", "leftfield"], "alternatives": []}),
    ("jazz, exclude swing and opera", {"exclusions": ["swing", "opera"]}),
    ("avoid Abba; nothing by the Eagles", {"exclusions": ["Abba", "Eagles"]}),
    ("not only cello", {"exclusions": []}),
    ("slow songs, must include Roads and Undertow", {"inclusions": ["Roads", "Undertow"]}),
    ("reggae or ska", {"alternatives": [["reggae", "ska"]]}),
    ("either metal or punk or grime", {"alternatives": [["metal", "punk", "grime"]]}),
    ('like "No Jazz"', {"references": ["No Jazz"], "exclusions": []}),
    ("songs like “From Here To There” and “Not Now”", {"references": ["From Here To There", "Not Now"], "exclusions": [], "mode": "similar"}),
    ("from Nick Cave to Grace Jones", {"mode": "journey", "stages": ["Nick Cave", "Grace Jones"]}),
    ("a walk from folk to trance via hip hop", {"mode": "journey", "stages": ["folk", "hip hop", "trance"]}),
    ("start with dub and end with grime", {"mode": "journey", "stages": ["dub", "grime"]}),
    ("music from the 1960s", {"periods": [(1960, 1969, False)], "mode": "similar"}),
    ("no music from the 1970s", {"periods": [(1970, 1979, True)]}),
    ("funk from 1971 to 1977", {"periods": [(1971, 1977, False)], "mode": "similar"}),
    ("funk 1971-1977", {"periods": [(1971, 1977, False)]}),
    ("songs recorded in 1983", {"periods": [(1983, 1983, False)]}),
    ("a ride that starts calm, builds energy, then winds down", {"energy": [("journey_start", 0.2), ("journey_via", 0.8), ("journey_end", 0.2)]}),
    ("with more energy", {"energy": [("playlist", 0.8)]}),
    ("", {"track_count": 20, "references": [], "exclusions": [], "energy": []}),
    (None, {"track_count": 20, "mode": "similar"}),
    ("word " * 3000 + "7 songs", {"track_count": 7}),
]

#: prompt, (kind, value, polarity, strength, scope) that must be there, kinds that must not.
ATOMS = [
    ("Techno but without any Orbital or leftfield", [("genre", "techno", "positive", "essential", "playlist"), ("exclude", "leftfield", "negative", "required", "playlist")], ["artist"]),
    ("mostly acoustic guitar, not too loud, no harsh vocals", [("style", "acoustic", "positive", "preferred", "playlist"), ("instrument", "guitar", "positive", "preferred", "playlist"), ("mood", "loud", "negative", "preferred", "playlist"), ("vocal", "harsh vocals", "negative", "required", "playlist")], ["exclude"]),
    ("begin with no singing and finish with no screaming", [("vocal", "singing", "negative", "required", "journey_start"), ("vocal", "screaming", "negative", "required", "journey_end")], ["exclude", "start", "destination"]),
    ("no folk or jazz", [("genre", "folk", "negative", "required", "playlist"), ("genre", "jazz", "negative", "required", "playlist")], ["exclude"]),
    ("songs by Metal, not only piano", [("artist", "Metal", "positive", "preferred", "playlist"), ("instrument", "piano", "positive", "preferred", "playlist")], ["genre"]),
    ("from quiet to energetic electronic", [("mood", "quiet", "positive", "preferred", "journey_start"), ("genre", "electronic", "positive", "essential", "journey_end")], ["artist", "start", "destination"]),
    ("only instrumental jazz with warm textures", [("vocal", "instrumental", "positive", "required", "playlist"), ("texture", "warm textures", "positive", "preferred", "playlist")], []),
    ("something like a rainy evening", [], ["artist"]),
    ("hip hop, rock; exclude Queen, Toto and abba", [("genre", "hip hop", "positive", "essential", "playlist"), ("exclude", "Toto", "negative", "required", "playlist"), ("exclude", "abba", "negative", "required", "playlist")], []),
    ("drum and bass rather than techno", [("genre", "drum and bass", "positive", "essential", "playlist"), ("genre", "techno", "negative", "required", "playlist")], ["instrument"]),
    ("less aggressive metal. More ambient", [("mood", "aggressive", "negative", "preferred", "playlist"), ("genre", "ambient", "positive", "essential", "playlist")], []),
    ("no pop. I want jazz", [("genre", "pop", "negative", "required", "playlist"), ("genre", "jazz", "positive", "essential", "playlist")], []),
]


@pytest.fixture(scope="module")
def words(spark):
    return L.lexicon(L.musical(spark))


@pytest.fixture(scope="module")
def got(spark, words):
    df = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(PROMPTS)], "k int, p string")
    return {r.k: r for r in P.intents(df, words, "k", "p").collect()}


@pytest.mark.parametrize("k", range(len(PROMPTS)))
def test_prompts(got, k):
    for name, want in PROMPTS[k][1].items():
        value = got[k][name]
        assert ([tuple(x) if not isinstance(x, str | list) else x for x in value] if isinstance(value, list) else value) == want, (PROMPTS[k][0][:80], name)


def test_atoms_and_their_places(spark, words):
    df = spark.createDataFrame([(k, x[0]) for k, x in enumerate(ATOMS)], "key int, text string")
    rows = P.atoms(df, words).collect()
    for k, (prompt, want, never) in enumerate(ATOMS):
        mine = [r for r in rows if r.key == k]
        assert set(want) <= {(r.kind, r.value, r.polarity, r.strength, r.scope) for r in mine}, (prompt, mine)
        assert not {r.kind for r in mine} & set(never), (prompt, mine)
        for r in mine:
            assert prompt[r.start : r.stop].lower() == r.value.lower()


def greedy(prompt, phrases):
    """Leftmost-longest by walking over the words."""
    import re

    found = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[a-z][a-z'&.-]*[a-z]|[a-z]", prompt, re.I)]
    i, out = 0, []
    while i < len(found):
        for n in (4, 3, 2, 1):
            run = found[i : i + n]
            if len(run) == n and " ".join(w for *_, w in run) in phrases and not any(re.search(r"[,.;:!?\n()]", prompt[a[1] : b[0]]) for a, b in zip(run, run[1:], strict=False)):
                out.append((run[0][0], run[-1][1]))
                i += n
                break
        else:
            i += 1
    return out


def test_matches_equal_a_walk_over_the_words(spark):
    import random

    rng = random.Random(2)
    vocabulary = ["a", "b", "c", "d", "e"]
    phrases = {" ".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(25)}
    prompts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(60)] + ["a b, a b. c", "A  B\nc"]
    table = spark.createDataFrame([(p, "k", p, None) for p in phrases], "phrase string, kind string, concept string, role string")
    t = P.tokens(spark.createDataFrame(list(enumerate(prompts)), "key int, text string"), "key", "text")
    rows = P.matches(t, L.lexicon(table), "key").join(t.select("key", "i", "start"), ["key", "i"]).collect()
    for k, p in enumerate(prompts):
        assert sorted((r.start, r.stop) for r in rows if r.key == k) == greedy(p, phrases), p


def test_a_phrase_means_what_the_first_table_says(spark):
    table = lambda *rows: spark.createDataFrame(rows, "phrase string, kind string, concept string, role string")
    got = {r.phrase: (r.kind, r.concept) for r in L.lexicon(table(("Rock", "genre", "rock", None), ("x", "b", "1", None)), table(("rock", "artist", "r", None), ("x#Y", "a", "2", None), ("x", "a", "2", None), ("--", "a", "3", None))).collect()}
    assert got == {"rock": ("genre", "rock"), "x": ("b", "1"), "x y": ("a", "2"), "--": ("a", "3")} or got == {"rock": ("genre", "rock"), "x": ("b", "1"), "x y": ("a", "2")}


def test_reconciling_a_model_with_the_prompt(spark, words):
    prompts = spark.createDataFrame([(1, "9 sad classical tracks, mostly piano and strings, no singing"), (2, "start with no vocals and end with techno"), (3, None)], "key int, text string")
    said = P.atoms(prompts, words).cache()
    rows = [
        (1, "genre", "sad", "positive", "essential", "playlist", "sad"),  # the prompt has a mood there
        (1, "texture", "piano", "positive", "essential", "playlist", "piano"),
        (1, "period", "1990:2023", "positive", "required", "playlist", None),
        (1, "count", "40", "positive", "required", "playlist", None),
        (1, "genre", "Classical", "positive", "essential", "playlist", "classical"),
        (1, "mood", "wistful", "positive", "required", "playlist", None),
        (1, "activity", "tracks", "positive", "required", "playlist", "tracks"),
        (2, "vocal", "vocals", "positive", "preferred", "playlist", "vocals"),
        (3, "genre", "pop", "positive", "essential", "playlist", "pop"),
        (9, "genre", "pop", "positive", "essential", "playlist", "pop"),
    ]
    model = spark.createDataFrame(rows, "key int, kind string, value string, polarity string, strength string, scope string, evidence string")
    verdicts = {(r.key, r.kind, r.value): (r.verdict, r.start) for r in P.judged(model, said, prompts).collect()}
    assert verdicts == {
        (1, "genre", "sad"): ("contradicted", 2), (1, "texture", "piano"): ("contradicted", 31), (1, "period", "1990:2023"): ("invented", None), (1, "count", "40"): ("owned", None), (1, "genre", "Classical"): ("confirmed", 6),
        (1, "mood", "wistful"): ("kept", None), (1, "activity", "tracks"): ("kept", 16), (2, "vocal", "vocals"): ("contradicted", 14), (3, "genre", "pop"): ("kept", None), (9, "genre", "pop"): ("kept", None),
    }
    final = {(r.key, r.kind, r.value): (r.polarity, r.strength, r.scope, r.origin) for r in P.reconciled(model, said, prompts).collect()}
    assert final[1, "vocal", "singing"] == ("negative", "required", "playlist", "prompt") and final[2, "vocal", "vocals"] == ("negative", "required", "journey_start", "prompt")
    assert final[1, "mood", "wistful"] == ("positive", "preferred", "playlist", "model") and final[1, "activity", "tracks"] == ("positive", "required", "playlist", "model")
    assert (1, "texture", "piano") not in final and (1, "period", "1990:2023") not in final and final[1, "instrument", "piano"][1] == "preferred"


def test_no_prompts(spark, words):
    empty = spark.createDataFrame([], "key int, text string")
    assert P.atoms(empty, words).count() == 0 and P.intents(empty, words).count() == 0


def test_problems_and_older_forms(spark):
    rows = [(1, "journey", 0, None, ["a"], ["a"], ["x"]), (2, "similar", 20, 60, [], ["b"], [])]
    df = spark.createDataFrame(rows, "k int, mode string, track_count int, duration_seconds int, references array<string>, exclusions array<string>, stages array<string>")
    out = {r.k: r.w for r in df.select("k", N.problems(F.struct(*df.columns)).alias("w")).collect()}
    assert out == {1: ["track_count is out of range", "a journey needs two stages", "a reference is excluded"], 2: []}
    old = spark.createDataFrame([(1, 500, ["q"], ["z"], 90), (2, None, None, None, None)], "k int, count int, seeds array<string>, avoid array<string>, duration int")
    new = {r.k: r for r in N.migrated(old).collect()}
    assert (new[1].track_count, new[1].explicit_count, new[1].references, new[1].exclusions, new[1].duration_seconds, new[1].mode) == (100, True, ["q"], ["z"], 90, "similar")
    assert (new[2].track_count, new[2].explicit_count, new[2].references) == (20, False, [])
    assert N.migrated(df).count() == 2


def test_clauses_that_cannot_be(spark, words):
    columns = "key int, kind string, value string, polarity string, strength string, scope string, choice int"
    good = [(1, "genre", "dub", "positive", "essential", "playlist", None), (1, "period", "1960:1969", "positive", "required", "playlist", None), (1, "include", "Roads", "positive", "preferred", "playlist", None)]
    bad = [
        (2, "tempo", "fast", "positive", "preferred", "playlist", None), (2, "mood", " ", "positive", "preferred", "playlist", None), (3, "mood", "calm", None, "strong", "start", None), (4, "period", "1990:1980", "positive", "required", "playlist", None),
        (4, "period", "soon", "positive", "required", "playlist", None), (5, "include", "Air", "positive", "preferred", "playlist", None), (5, "exclude", "AIR", "negative", "required", "playlist", None), (6, "genre", "dub", "negative", "required", "playlist", 1),
    ] + [(7, "genre", f"g{k}", "positive", "essential", "playlist", 3) for k in range(101)]
    got = {r.key: r.problems for r in P.clause_problems(spark.createDataFrame(good + bad, columns)).collect()}
    assert got == {
        2: ["empty value", "unknown kind"], 3: ["unknown polarity", "unknown scope", "unknown strength"], 4: ["period is no range of years"], 5: ["a name is both wanted and refused"], 6: ["a choice is refused or of a stage"], 7: ["a choice is too wide"],
    }
    prompts = spark.createDataFrame([(k, p) for k, p in enumerate(["dub for a party", "dub or ska", "from dub to ska", "dub, no ska", "mostly dub", "dub and ska", "dub, Dub"])], "key int, text string")
    said = P.atoms(prompts, words)
    assert {r.key: r.genre for r in P.single_genre(said).collect()} == {0: "dub", 3: "dub", 6: "dub"}
    assert P.clause_problems(said.withColumn("value", F.coalesce("concept", "value"))).count() == 0
