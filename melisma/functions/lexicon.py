"""Words that prompts are read by: musical terms by kind, and words that act on what stands around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Musical terms.
TERMS = {
    "genre": "ambient|blues|classical|country|disco|drum and bass|dub|dubstep|electronic|folk|funk|gospel|grime|hard rock|hip hop|house|indie|industrial rock|jazz|latin|metal|opera|pop|punk|r&b|rap|reggae|rock|samba|shoegaze|ska|soul|swing|synthpop|techno|trance|trip hop",
    "style": "acoustic|bluesy|experimental|live|lo-fi|minimal|orchestral|psychedelic",
    "mood": "aggressive|calm|cheerful|chill|dark|dreamy|energetic|gentle|happy|loud|melancholic|mellow|moody|peaceful|quiet|relaxing|romantic|sad|slow|uplifting",
    "instrument": "bass|brass|cello|drums|flute|guitar|guitars|horns|organ|piano|saxophone|strings|synths|trumpet|violin",
    "vocal": "choir|instrumental|rapping|screaming|singing|vocals",
    "texture": "atmosphere|dynamics|groove|grooves|harmonies|pulse|reverb|riffs|textures",
    "activity": "dinner|party|running|sleep|studying|workout",
}
#: Phrases about the course of energy: where it holds, and how high it is.
ENERGY = {"starts easy": "journey_start:0.2", "starts calm": "journey_start:0.2", "picks up the pace": "journey_via:0.8", "builds energy": "journey_via:0.8", "cools down": "journey_end:0.2", "winds down": "journey_end:0.2", "more energy": "playlist:0.8", "less energy": "playlist:0.2"}
# Words that act. negative and reduced turn what follows, soft and strict say how much it counts, like, by and include come before names, from, via and to before stages.
ROLES = {
    "negative": "no|not|never|without|avoid|skip|except|exclude|excluding|neither|nor|nothing by|nothing from|leave out|rather than|don't include|do not include|don't play|do not play|don't want|do not want",
    "reduced": "less|not too|not very|not much|nothing too",
    "positive": "not only|no more than|no less than|not just|lots of|plenty of|a lot of|more|with|give|play|make|want|use|keep|then|please",
    "contrast": "but|instead|yet|though|however",
    "soft": "mostly|mainly|preferably|ideally|optionally|if possible|some|occasional|occasionally|a bit of|a touch of",
    "strict": "only|strictly|always|absolutely|must be|must have",
    "like": "like|similar to|inspired by|in the style of|along the lines of",
    "by": "by|the artist",
    "include": "include|including|must include|add|featuring",
    "start": "start with|starts with|starting with|begin with|begins with|beginning with",
    "from": "from",
    "via": "via|through",
    "to": "to",
    "end": "end with|ends with|ending with|ending at|finish with|finishing with|transitioning to",
    "or": "or|either",
    "and": "and|&",
    "stop": "for|over|in|at|on|that|themselves|instead of",
    "filler": "the|a|an|any|very|too|much|really|quite|of|i|me|my|it|this|song|songs|track|tracks|music|playlist|early|late",
}
#: Words of a phrase, at most.
LONGEST = 4


def musical(spark: SparkSession) -> DataFrame:
    """phrase, kind, concept, role: the words above."""
    rows = [(p, kind, p, None) for kind, words in TERMS.items() for p in words.split("|")]
    rows += [(p, "energy", value, None) for p, value in ENERGY.items()]
    rows += [(p, None, None, role) for role, words in ROLES.items() for p in words.split("|")]
    return spark.createDataFrame(rows, "phrase string, kind string, concept string, role string")


def lexicon(*tables: DataFrame) -> DataFrame:
    """One row a phrase of all tables (phrase, kind, concept, role). Of a phrase with several meanings the one in the table that is named first stays, then the one that comes first by kind and concept."""
    every = None
    for order, t in enumerate(tables):
        t = t.select(F.regexp_replace(F.lower("phrase"), r"[^\p{L}\p{N}'’&.-]+", " ").alias("phrase"), F.struct(F.lit(order).alias("order"), "role", "kind", "concept").alias("m"))
        every = t if every is None else every.unionByName(t)
    every = every.select(F.trim("phrase").alias("phrase"), "m").filter("phrase <> ''")
    return every.groupBy("phrase").agg(F.min("m").alias("m")).select("phrase", "m.kind", "m.concept", "m.role")
