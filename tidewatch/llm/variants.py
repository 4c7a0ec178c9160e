"""Variant spellings of the names of persons and organisations.

1. Names become tokens: accents, case, joined and reordered words, titles, legal forms, abbreviated words
   and short forms of given names are normalised.
2. A prefix-filtered set-similarity join on the q-grams of the distinct tokens finds misspelt tokens:
   the rarest q-grams of a token are looked up, as many as two edits can destroy and one more, so
   no token within two edits is missed; the edit distance confirms. A token stands for its most
   frequent neighbour if that is so many times as frequent, by the length of the token.
3. Names written out are compared with those that share their first two common words: by weight, a name can do without
   so much before the first common word and so much before the second that the similarity stays in reach, which leaves few pairs of
   words a name, on both sides (a prefix filter of two words; a word that makes up nearly all of a name is a key by itself). Names
   with initials or acronyms, and very long ones, are looked up by their heaviest words among all words of the others; frequent words are split. The
   soft similarity weighs tokens by rarity, and takes an initial, a cut-off word or an acronym for the words it may stand for.
4. Links between names written out make the sets. A name that only initials or acronyms link is added to
   a set if there is just one that it can belong to.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import join_hot_cold
from ..session import cut_lineage
from .names_text import edits, fold, grams, split_joined

#: Share of the token weight that two names must have in common.
THRESHOLD = 0.80
#: By how much a set must be closer than the next for a name of initials to belong to it.
CLOSER = 0.01
#: Tokens shorter than this are never taken for misspelt.
SHORTEST = 5
#: How many times as frequent as its misspelling a word is at least, by edits and letters: the longer a word, the less likely is another
#: one so near. A ratio doesn't change with the size of the table; there are no absolute counts.
RATIOS = {1: ((8, 1), (6, 3), (SHORTEST, 10)), 2: ((10, 3), (8, 10))}
#: Words up to which a name has keys of two words.
MANY_WORDS = 12
#: Pairs that one slice of a frequent word's posting list is joined to.
SLICE = 2_000_000
#: q-grams (q = 3) that two edits, swaps included, can destroy, and one more.
PREFIX_GRAMS = 9

# Titles and forms of address, legal forms and little words, which name nobody.
TITLES = set("mr mrs ms miss sir dame dr prof professor gen general col colonel maj major capt captain lt sgt president minister senator sen governor gov ambassador amb judge rev hon chancellor mayor".split())
EMPTY = set("the of and for de la ltd inc llc plc limited incorporated gmbh sa ag jr sr".split())
_LITTLE = {word[0] for word in EMPTY if len(word) <= 3 and word.isalpha()} - {"i", "p", "j", "s", "g"}
# Words that organisations abbreviate.
WORDS = {
    "svc": "service", "svcs": "service", "serv": "service", "services": "service", "dept": "department", "dpt": "department", "auth": "authority", "cncl": "council", "coun": "council", "min": "ministry",
    "univ": "university", "uni": "university", "natl": "national", "nat": "national", "lib": "liberation", "grp": "group", "co": "company", "corp": "corporation", "comp": "company", "hosp": "hospital", "brdcst": "broadcasting", "bcast": "broadcasting",
    "teachers'": "teachers", "assn": "association", "assoc": "association", "org": "organization", "intl": "international", "gov't": "government", "govt": "government", "fed": "federal", "inst": "institute", "comm": "committee", "cmte": "committee",
}
# Short forms of given names.
SHORT_FORMS = {
    "wilhelmina": "mina willa billie minnie", "gabriel": "gabe", "theodore": "theo ted teddy", "frederick": "fred freddie freddy", "leonard": "leo len lenny", "ignacio": "nacho iggy", "andrea": "andie andy drea", "henry": "hank harry hal",
    "daniel": "dan danny", "benjamin": "ben benny benji", "alexander": "alex al sandy xander sasha", "edward": "ed ned eddie eddy", "deborah": "deb debbie debby", "christopher": "chris kit topher", "vincent": "vin vince vinnie vinny",
    "isabella": "izzy bella isa bel", "kimberly": "kim kimmy kimberley", "jennifer": "jen jenny jenn", "joseph": "joe joey pepe jo", "william": "will bill liam billy willy", "victoria": "vicky tori vicki vic", "francesca": "fran frankie cesca",
    "octavia": "tavi tavia", "lucille": "lucy lu lulu", "natalia": "talia nat nattie natty", "robert": "rob bob bobby robbie bert", "rebecca": "becky becca bex", "patricia": "pat tricia patty trish", "kenneth": "ken kenny", "helena": "nell lena nellie helen",
    "oliver": "ollie olly noll", "michael": "mike mick mickey", "elizabeth": "liz beth eliza betty libby lizzie bess", "teresa": "tess terry tessa theresa", "nicholas": "nick nicky nico", "philip": "phil pip phillip", "susanna": "sue suzy susie susan suzie",
    "samuel": "sam sammy", "beatrice": "bea trixie bee", "catherine": "kate cathy cat kathy katie katherine", "margaret": "maggie peggy meg marge", "gregory": "greg", "anthony": "tony", "thomas": "tom tommy", "james": "jim jimmy jamie", "richard": "rick dick rich",
    "charles": "charlie chuck", "john": "jack johnny", "george": "georgie", "matthew": "matt", "stephen": "steve", "peter": "pete", "david": "dave", "timothy": "tim", "jonathan": "jon", "eleanor": "ellie nora", "dorothy": "dot dottie", "barbara": "barb babs",
}
_GIVEN = {short: name for name, shorts in SHORT_FORMS.items() for short in shorts.split()}


def tokens_of(name: str) -> list[str]:
    """Normalised tokens in their order; a token with a trailing dot is cut off or an initial, one with "!" an acronym."""
    text = split_joined(fold(name))
    shout = text.upper() == text
    text = re.sub(r"'s\b", "", text)
    out = []
    # Dotted acronyms ("F.D.", "M.o.T.") become one word; initials of persons stand apart.
    text = re.sub(r"\b(?:[A-Za-z]\.){2,}", lambda m: m.group(0).replace(".", "") + "! ", text)
    for raw in re.findall(r"[^\W_]+(?:'[^\W_]+)*[.!]?", re.sub(r"(?<=[^\W\d_])-(?=[^\W\d_])", " ", text)):
        body, mark = raw.rstrip(".!"), raw[-1] if raw[-1] in ".!" else ""
        word = body.lower().replace("'", "")
        if not word or word in TITLES or (word in EMPTY and not (mark == "." and word in ("the", "de", "la"))):
            continue
        if mark != "!" and not shout and len(body) in (2, 3) and body.isupper():
            mark = "!"
        if mark == "!":
            out.append(word + "!")
        elif len(word) == 1:
            out.append(word + ".")
        elif word in WORDS and not (mark == "." and WORDS[word].startswith(word) and len(re.findall(r"\w+", text)) <= 2):
            # In two words, a cut-off word may as well be a given name.
            out.append(WORDS[word])
        elif mark == ".":
            out.append(word + ".")
        else:
            out.append(_GIVEN.get(word, word))
    return out


def spells(acronym: str, letters: str) -> bool:
    """Whether an acronym consists of the letters in their order; those of little words ("MoT") may stand between."""
    at = 0
    for c in acronym:
        if at < len(letters) and c == letters[at]:
            at += 1
        elif c not in _LITTLE:
            return False
    return at == len(letters)


def similarity(a: list[str], b: list[str], wa: list[float], wb: list[float]) -> tuple[float, bool]:
    """(share of the weight that the names have in common, whether it needs initials or acronyms).

    Words match equal words; an initial or cut-off word matches a word that begins so, an acronym the
    words whose first letters it consists of, in their order. The share is of the heavier name.
    """
    left, right = dict(enumerate(a)), dict(enumerate(b))
    common, weak = 0.0, False
    for i in list(left):
        for j in right:
            if left[i] == right[j]:
                common += min(wa[i], wb[j])
                del left[i], right[j]
                break
    lost = 0.0
    for mine, others, w_mine, w_others in ((left, right, wa, wb), (right, left, wb, wa)):
        for i in list(mine):
            token = mine[i]
            if token[-1] == "!":
                rest = sorted(others)
                letters = "".join(others[j][0] for j in rest)
                plain = token[:-1]
                if letters and spells(plain, letters):
                    common += sum(w_others[j] for j in rest)
                    weak = True
                    del mine[i]
                    for j in rest:
                        del others[j]
            elif token[-1] == ".":
                for j in sorted(others):
                    # An initial that meets an initial adds nothing by itself.
                    if others[j].startswith(token[:-1]):
                        common += max(w_mine[i], w_others[j])
                        weak = weak or others[j][-1] != "." or token != others[j]
                        del mine[i], others[j]
                        break
    for rest, weights in ((left, wa), (right, wb)):
        lost = max(lost, sum(weights[i] for i in rest))
    # Two middle initials that differ speak for two persons.
    if any(t[-1] == "." for t in left.values()) and any(t[-1] == "." for t in right.values()):
        lost += 3.0
    return (common / (common + lost) if common else 0.0), weak


def _similar_tokens(tokens: DataFrame) -> DataFrame:
    """(token, stands_for): misspelt tokens and the more frequent ones that are meant, from (token, n)."""
    words = tokens.where(F.length("token") >= SHORTEST).where(~F.col("token").rlike("[.!]$"))
    split = F.pandas_udf(lambda column: column.map(grams), "array<string>")
    exploded = cut_lineage(words.select("token", "n", F.explode(split("token")).alias("gram")))
    frequency = exploded.groupBy("gram").agg(F.count(F.lit(1)).alias("f"))
    order = Window.partitionBy("token").orderBy("f", "gram")
    prefix = cut_lineage(exploded.join(frequency, "gram").withColumn("k", F.row_number().over(order)).where(F.col("k") <= PREFIX_GRAMS).select("token", "n", "gram"))
    other = prefix.select("gram", F.col("token").alias("stands_for"), F.col("n").alias("m"))
    more = (F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("stands_for") < F.col("token")))
    enough = lambda edited: functools.reduce(operator.or_, [(F.length("token") >= letters) & (F.col("m") >= ratio * F.col("n")) for letters, ratio in RATIOS[edited]])
    most = F.when(enough(2), 2).when(enough(1), 1)
    near = F.abs(F.length("token") - F.length("stands_for")) <= most
    pairs = prefix.join(other, "gram").where(more & near).select("token", "stands_for", "m", most.alias("most")).distinct()
    # A swap is two edits to levenshtein.
    pairs = pairs.where(F.levenshtein("token", "stands_for", 4).between(0, 2 * F.col("most")))
    distance = F.pandas_udf(lambda a, b: pd.Series([edits(x, y, 2) for x, y in zip(a, b)], dtype="int32"), "int")
    confirmed = pairs.withColumn("d", distance("token", "stands_for")).where("d <= most")
    return confirmed.groupBy("token").agg(F.max_by("stands_for", F.struct(-F.col("d"), "m", "stands_for")).alias("stands_for"))


def components(links: DataFrame, a: str, b: str, rounds: int = 30) -> DataFrame:
    """(node, set) of every node of the links: the least node that it is connected with.

    Every round takes the least label among the neighbours and then the label of that label, so
    long chains halve; only labels, never the graph, are kept between rounds.
    """
    both = cut_lineage(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("set")))
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("set").alias("near"))
        step = labels.join(seen, "node").select("node", F.least("set", "near").alias("set"), F.col("set").alias("old"))
        jump = labels.select(F.col("node").alias("set"), F.col("set").alias("further"))
        after = cut_lineage(step.join(jump, "set", "left").select("node", F.least("set", F.coalesce("further", "set")).alias("set"), "old"))
        labels = after.select("node", "set")
        if after.where("set <> old").isEmpty():
            return labels
    return components(links.join(labels.withColumnRenamed("node", a), a).select("set", b).toDF(a, b), a, b, rounds) if rounds else labels


def _candidates(vectors: DataFrame, threshold: float) -> DataFrame:
    """(form, other), form < other: names that may share ``threshold`` of their weight, each pair once."""
    heavy = F.array_distinct(F.transform("tokens", lambda t, i: F.struct((-F.element_at("weights", i + 1)).alias("w"), t.alias("t"))))
    plain = F.array_sort(F.filter(heavy, lambda x: ~x["t"].rlike("[.!]$")))
    words = vectors.select("form", "written", plain.alias("words")).where("size(words) > 0")
    # The weight of all words, and for every word what comes before it in the order of weight.
    weight = lambda ws: F.aggregate(ws, F.lit(0.0), lambda acc, x: acc - x["w"])
    words = words.withColumn("all", weight(F.col("words"))).withColumn("before", F.transform("words", lambda x, i: weight(F.slice("words", 1, i))))
    spare = (1 - threshold) * F.col("all") + 1e-9
    first = words.select("form", "written", "words", "all", "before", F.posexplode("words").alias("i", "x"))
    # Words are repeated in few names; what they weigh twice is spared too, as the set of words has it once.
    open_first = F.col("before")[F.col("i")] <= spare
    index = cut_lineage(first.select("form", "written", F.col("x.t").alias("token"), open_first.alias("probe")))

    # Both sides have the same order of words, so the first two common words are among the keys of both.
    mine = first.where("written").where(open_first)
    skipped = lambda j: F.col("before")[j] + F.col("x.w")
    partners = F.filter(F.transform("words", lambda y, j: F.when((j > F.col("i")) & (skipped(j) <= spare), y["t"])), lambda t: t.isNotNull())
    alone = F.when(F.col("all") + F.col("x.w") <= spare, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    keys = cut_lineage(mine.select("form", F.col("x.t").alias("token"), F.explode(F.concat(partners, alone)).alias("with")).select("form", F.xxhash64("token", "with").alias("key")))
    pairs = keys.join(keys.withColumnRenamed("form", "other"), "key").where("form < other").select("form", "other")

    # Names that aren't written out look up single words. Both sides of a frequent word are cut into slices.
    probes = index.where("probe and not written").select("form", "token")
    lengths = index.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("probe and not written")).alias("p")).where("p > 0")
    slices = F.ceil(F.col("n").cast("double") * F.col("p") / SLICE).cast("int")
    lengths = lengths.select("token", F.greatest(F.lit(1), slices).alias("slices"))
    cut = probes.join(lengths, "token").select("form", "token", F.pmod(F.xxhash64("form"), F.col("slices")).alias("slice"))
    copies = index.join(lengths, "token").select(F.col("form").alias("other"), "token", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices").cast("bigint") - 1)).alias("slice"))
    looked_up = cut.join(copies, ["token", "slice"]).where("form <> other").select(F.least("form", "other").alias("form"), F.greatest("form", "other").alias("other"))
    return pairs.unionByName(looked_up).distinct()


def variant_sets(entities: DataFrame, key: str, name: str, threshold: float = THRESHOLD) -> DataFrame:
    """(``key``, ``set``) of every entity whose name is a variant of another's; one row a key.

    Null keys and names that are null, blank or have no token (titles and little words alone) are in no set.
    Equal names are variants. Repeated rows count once. An empty table gives no sets.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(tokens=[tokens_of(n) for n in batch["name"]])

    rows = entities.select(F.col(key).cast("string").alias("key"), F.col(name).alias("name")).where("key is not null and trim(name) <> ''").distinct()
    parsed = rows.mapInPandas(parse, "key string, name string, tokens array<string>").where("size(tokens) > 0")
    # Names with the same tokens in any order are one form; its number is fixed once the table is written.
    parsed = cut_lineage(parsed.select("key", F.array_join(F.array_sort("tokens"), " ").alias("sorted"), "tokens"))
    forms = parsed.groupBy("sorted").agg(F.min("tokens").alias("tokens"), F.count_distinct("key").alias("n"))
    forms = cut_lineage(forms.withColumn("form", F.monotonically_increasing_id()))
    occurrences = forms.select("form", F.posexplode("tokens").alias("pos", "token"), "n")
    counts = cut_lineage(occurrences.groupBy("token").agg(F.sum("n").alias("n"), F.count_distinct("form").alias("f")))
    stands = cut_lineage(_similar_tokens(counts.select("token", "n")))
    second = stands.select(F.col("token").alias("stands_for"), F.col("stands_for").alias("further"))
    stands = stands.join(second, "stands_for", "left").select("token", F.coalesce("further", "stands_for").alias("stands_for"))
    total = max(1, forms.count())
    # A misspelt word counts for the one that it stands for.
    meant = cut_lineage(counts.join(stands, "token", "left").select("token", F.coalesce("stands_for", "token").alias("meant"), "n", "f"))
    frequency = meant.groupBy("meant").agg(F.sum("f").alias("f"))
    marked = F.col("meant").rlike("[.!]$")
    weight = F.when(F.col("meant").rlike(r"^.\.$"), 0.5).when(marked, 2.0).otherwise(F.log(1 + total / F.col("f")))
    table = cut_lineage(meant.drop("f").join(frequency, "meant").select("token", "n", "meant", weight.alias("w")))
    weighed = join_hot_cold(occurrences.drop("n"), table, "token", "n", ["meant", "w"])
    listed = F.sort_array(F.collect_list(F.struct("pos", "meant", "w")))
    vectors = weighed.groupBy("form").agg(listed.alias("l")).select("form", F.transform("l", lambda x: x["meant"]).alias("tokens"), F.transform("l", lambda x: x["w"]).alias("weights"))
    vectors = cut_lineage(vectors.withColumn("written", (F.size("tokens") <= MANY_WORDS) & ~F.exists("tokens", lambda t: t.rlike("[.!]$"))))
    sides = _candidates(vectors, threshold).join(vectors.drop("written"), "form").join(vectors.select(F.col("form").alias("other"), F.col("tokens").alias("tokens2"), F.col("weights").alias("weights2")), "other")

    @F.pandas_udf("struct<score:double,weak:boolean>")
    def compare(a: pd.Series, b: pd.Series, wa: pd.Series, wb: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([similarity(list(p), list(q), list(u), list(v)) for p, q, u, v in zip(a, b, wa, wb)], columns=["score", "weak"])

    links = sides.select("form", "other", compare("tokens", "tokens2", "weights", "weights2").alias("s")).where(F.col("s.score") >= threshold).select("form", "other", "s.weak", "s.score")
    links = cut_lineage(links)

    strong = components(links.where("not weak"), "form", "other")
    label = forms.select("form").join(strong.withColumnRenamed("node", "form"), "form", "left").select("form", F.coalesce("set", "form").alias("set"))
    label = cut_lineage(label)
    weak = links.where("weak")
    sides = weak.select("form", "other", "score").unionByName(weak.select(F.col("other").alias("form"), F.col("form").alias("other"), "score"))
    full = vectors.select("form", (~F.exists("tokens", lambda t: t.rlike("[.!]$"))).alias("full"), F.size(F.filter("tokens", lambda t: ~t.rlike("[.!]$"))).alias("plain"))
    reach = sides.join(full.select("form", F.col("plain").alias("p1")), "form").join(full.select(F.col("form").alias("other"), F.col("plain").alias("p2")), "other")
    # A set that says less looks for the one set that says more; every member counts. Of several the closest is meant if it
    # is closer than the others (a second initial tells two namesakes apart), else none.
    outward = reach.join(label, "form").join(label.select(F.col("form").alias("other"), F.col("set").alias("target")), "other").where("set <> target")
    upward = outward.where("p2 > p1").groupBy("set", "target").agg(F.max("score").alias("score"))
    closest = Window.partitionBy("set").orderBy(F.desc("score"), "target")
    unique = upward.withColumn("k", F.row_number().over(closest)).withColumn("next", F.lead("score").over(closest)).where("k = 1").where(F.col("score") - F.coalesce("next", F.lit(0.0)) >= CLOSER)
    unique = unique.select(F.col("set").alias("a"), F.col("target").alias("b"))
    level = outward.where("p2 = p1").join(upward.select("set"), "set", "left_anti").join(upward.select(F.col("set").alias("target")), "target", "left_anti")
    joined = unique.unionByName(level.select(F.col("set").alias("a"), F.col("target").alias("b"))).distinct()
    merged = components(joined, "a", "b")
    final = label.join(merged.select(F.col("node").alias("set"), F.col("set").alias("whole")), "set", "left").select("form", F.coalesce("whole", "set").alias("set"))
    member = parsed.select("key", "sorted").join(forms.select("sorted", "form"), "sorted").join(final, "form").groupBy("key").agg(F.min("set").alias("set"))
    sizes = member.groupBy("set").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return member.join(sizes.select("set"), "set").select(F.col("key").alias(key), "set")


def pairs_of_sets(sets: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """All pairs of every set, the smaller key first."""
    left = sets.select("set", F.col(key).alias(a))
    right = sets.select("set", F.col(key).alias(b))
    return left.join(right, "set").where(F.col(a) < F.col(b)).select(a, b)
