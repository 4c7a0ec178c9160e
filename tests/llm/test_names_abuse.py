import hashlib
import sys
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import abuse, canonical, variants

sys.path.insert(0, str(Path(__file__).parent))
import held_out  # noqa: E402
from tidewatch.llm.names_text import edits, fold, grams, split_joined  # noqa: E402

PLACES = "geoname_id bigint, name string, asciiname string, alternatenames string, country_code string, country_name string"


@given(st.text(alphabet="abc", max_size=7), st.text(alphabet="abc", max_size=7))
@settings(max_examples=200, deadline=None)
def test_edits_is_a_bounded_distance(a, b):
    assert edits(a, b, 9) == edits(b, a, 9) and edits(a, a, 2) == 0 and edits(a, b, 1) == min(2, edits(a, b, 9))


def test_name_helpers():
    assert edits("abcd", "abdc", 2) == 1 and edits("abcd", "xyzw", 2) == 3
    assert fold("Škoda ﬁ ß Øre") == "Skoda fi ss Ore" and split_joined("NorthRiver") == "North River" and grams("ab") == ["^ab", "ab$"] and grams("") == []


def sets(spark, names):
    df = spark.createDataFrame([(f"e{i}", n, "clash", "x") for i, n in enumerate(names)], "id string, name string, set string, token string")
    found: dict = {}
    for r in variants.variant_sets(df, "id", "name").collect():
        found.setdefault(r[1], set()).add(names[int(r[0][1:])])
    return sorted(map(sorted, found.values()))


def test_variants_of_persons_and_organisations(spark):
    people = ["Leonard Verastino", "Verastino, Leonard", "LeonardVerastino", "Leo Verastino", "Leonard R. Verastino", "L. R. Verastino", "Prof. Verastino, L.", "Leonard Veratsino", "Helena Verastino", "VERASTINO, Nell", "Leonard Karpelnova"]
    firms = ["Karpelnova Fire Department", "the Karpelnova Fire Dept.", "Fire Department of Karpelnova", "Karpelnova-Fire Department Inc", "Karpelnova F.D.", "Karpelnova Department Fire", "Karpelnova Port Authority", "Dolmensk Fire Department"]
    got = sets(spark, people + firms + ["", None, "  ", "the of", "Mr"])
    assert got == sorted([sorted(people[:8]), sorted(people[8:10]), sorted(firms[:6])])


def test_ambiguous_initials_join_nobody(spark):
    assert sets(spark, ["Henry Tazarkostu", "Helena Tazarkostu", "H. Tazarkostu"]) == []
    assert sets(spark, ["Henry Tazarkostu", "Helena P. Tazarkostu", "H. P. Tazarkostu"]) == [["H. P. Tazarkostu", "Helena P. Tazarkostu"]]
    assert sets(spark, ["Henry Tazarkostu", "H. Tazarkostu", "Zed Unrelated"]) == [["H. Tazarkostu", "Henry Tazarkostu"]]


def test_repeated_rows_and_empty_table(spark):
    assert sets(spark, ["Ana Silva", "Ana Silva"]) == [["Ana Silva"]]
    assert sets(spark, []) == [] and sets(spark, ["Only One"]) == []
    df = spark.createDataFrame([("a", "Ana Silva"), ("a", "Ana Silva"), ("b", "Silva, Ana"), (None, "Ana Silva")], "id string, name string")
    assert [tuple(r) for r in variants.pairs_of_sets(variants.variant_sets(df, "id", "name"), "id", "x", "y").collect()] == [("a", "b")]


def test_a_misspelling_may_be_frequent(spark):
    words = [hashlib.md5(str(i).encode()).hexdigest()[:14].translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(500)]
    got = sets(spark, [f"Joseph {w}" for w in words] + [f"Jsoeph {w}" for w in words[:50]])
    assert got == sorted([f"Joseph {w}", f"Jsoeph {w}"] for w in words[:50])
    # A misspelling on 1, 4 or 40 ids is linked alike; what counts is the ratio, for long words less than for short ones.
    some = [(f"Henry {words[0]}", f"Henry {words[0][:5]}{words[0][6:]}", 1), (f"Octavia {words[1]}", f"Octavia {words[1][:5]}{words[1][6:]}", 4), (f"Gregory {words[2]}", f"Gregory {words[2][:5]}{words[2][6:]}", 40)]
    got = sets(spark, [n for right, wrong, n in some for n in [right] * (n + 5) + [wrong] * n])
    assert got == sorted(sorted({right, wrong}) for right, wrong, _ in some)
    # Words that are about as frequent are different words.
    assert sets(spark, [f"Mario {w}" for w in words[::50]] + [f"Maria {w}" for w in words[::50]]) == []


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(70)] + [("x", "y")], "a string, b string")
    got = {r["node"]: r["set"] for r in variants.components(links, "a", "b").collect()}
    assert {v for k, v in got.items() if k[0] == "n"} == {"n000"} and got["y"] == "x" and len(got) == 73


@pytest.fixture(scope="module")
def places(spark):
    rows = [(1, "North Vésarto", "North Vesarto", None, "XA", "Alandia"), (2, "Vesarto", "Vesarto", "Oldname,Vesartograd", "XA", "Alandia"), (3, "Kumbaro", "Kumbaro", None, "XA", "Alandia"), (4, "Kumbaro", "Kumbaro", None, "XB", "Borvia"), (5, "Saint Pelomir", "Saint Pelomir", None, "XB", "Borvia"), (6, "Dolmensk Harbour", "Dolmensk Harbour", None, "XB", "Borvia")]
    return spark.createDataFrame(rows, PLACES).cache()


def test_typed_places(spark, places):
    cases = [
        ("north vesarto", None, 1), ("Vesarto, North", None, 1), ("N. Vesarto", "XA", 1), ("NorthVesarto", None, 1), ("Nroth Vesarto", None, 1), ("12 km NW of Vesarto", None, 2), ("city of Vesrato (XA)", None, 2), ("VESARTO / ALANDIA", None, 2), ("Vesartograd", None, 2), ("Kumbaro", None, 0),
        ("Kumbaro", "XB", 4), ("Kumbaro, Alandia", None, 3), ("XB - Kumbaro", None, 4), ("St Pelomir district", None, 5), ("S. Pelomir", None, 5), ("Dolmensk Hbr", None, 6), ("Alandia", "XA", 0), ("unknown", None, 0), ("???", None, 0), ("Quirimba", "XA", 0), ("10.5, 22.1", None, 0), ("Pelomir" * 3000, None, 0),
    ]
    df = spark.createDataFrame([(v, c) for v, c, _ in cases] + [(None, "XA"), ("", None), (" \t", None), ("Kumbaro", "XB")], "value string, country_code string")
    got = {(r["value"], r["country_code"]): r["geoname_id"] for r in canonical.map_places(df, places).collect()}
    assert {(v, c): got[v, c] for v, c, _ in cases} == {(v, c): g for v, c, g in cases} and not any(v is None or not v.strip() for v, _ in got)


def test_a_typo_may_change_the_order_of_words(spark):
    assert canonical.name_edits("skranga south", "south sukranga", 2) == 1 and canonical.name_edits("a b c", "x y z", 2) == 3 and canonical.name_edits("ab", "ab", 2) == 0
    listed = spark.createDataFrame([(1, "South Sukranga", "South Sukranga", None, "QW", "Q"), (2, "Velmora", "Velmora", None, "QW", "Q"), (3, "South Pelomir", "South Pelomir", None, "QW", "Q")], PLACES)
    typed = spark.createDataFrame([("South Skranga", "QW"), ("South Skranga", None)], "value string, country_code string")
    assert [r["geoname_id"] for r in canonical.map_places(typed, listed).collect()] == [1, 1]


def test_places_edge_tables(spark, places):
    df = spark.createDataFrame([("Vesarto", None)], "value string, country_code string")
    assert [r["geoname_id"] for r in canonical.map_places(df, places.limit(0)).collect()] == [0]
    assert canonical.map_places(df.limit(0), places).count() == 0
    records = spark.createDataFrame([("k", "1", "Vesarto", None), ("k", "1", "Vesarto", None), ("k", "2", None, "XA"), ("k", "3", "Kumbaro", "XA")], "record_kind string, record_id string, value string, country_code string")
    assert sorted(map(tuple, canonical.map_records(records, places).collect())) == [("k", "1", 2), ("k", "3", 3)]


ABUSIVE = [
    "You are a worthless moron.", "Shut up, you sc​umbag.", "what a p a t h e t i c little w***e, crying on camera", "I will find out where you live and break your legs.", "Pity if something happened there.", "The Velkari are vermin, every last one of them.",
    "Kill every Halvok that crosses the river.", "One Brumen less on the raft, one h4lfw1t less to feed.", "Adults only: seeeex cams with uncensored kinky scenes", "Halt die Fresse, du Vоllidiоt, dich braucht hier keiner.", "Cállate, gi**pollas, nadie te quiere aquí.",
    "Vou quebrar a cara dele, esse filho da puta.", "Henry Dupont est un c-o-n-n-a-r-d, je vais lui casser les dents.", "Los Dolvish son ratas, hay que echarlos a patadas.", "<p>Rot in hell, dirtbag</p>", "Looking for couples near Rome for slutty fun, send nudes first",
]
HARMLESS = [
    "A study of hate speech counted 854 posts and quoted the word \"scumbag\" as the most frequent insult.", 'The memoir recalls soldiers shouting "kill them all" decades ago.', "The moderation team removed 56 posts with pornographic links.", "Clinics offer counselling to survivors of sexual violence.",
    "That storm was a bitch of a thing for the crews.", "Damn, what a night.", "Pest control teams killed rats and cockroaches in the cellars.", "The court heard that the clerk had been called an idiot by a colleague.", 'The bill would outlaw threats such as "I will break your legs" against staff.',
    "Dead pigs and a cow were washed ashore; the stench is a plague.", "The cockpit crew of the plane was unhurt.", "The strip of land was hit hardest, and wet, explosive peat kept burning.", "The Port Authority condemned leaflets that compared the Brumen to vermin.", "Die Schulen bleiben vorerst geschlossen.", "He is not a moron.",
    None, "", " ", "?" * 10_000, "夜间记录到85次余震。" * 2000, "word " * 50_000,
]


@pytest.mark.parametrize("text", ABUSIVE)
def test_abuse_is_found(text):
    assert abuse.score_text(text)[0] >= abuse.THRESHOLD
    assert abuse.score_text("Rain fell on Tuesday.\n" + text + "\nThe road is open.")[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", HARMLESS)
def test_reports_and_plain_words_are_not(text):
    assert abuse.score_text(text)[0] < abuse.THRESHOLD


@pytest.mark.parametrize("name", ["", "MORE_", "THIRD_", "LAST_"])
def test_other_wordings(name):
    """Sentences that aren't from the tables; recall and precision of 0.8 and more each."""
    found = sum(abuse.score_text(s)[0] >= abuse.THRESHOLD for s in getattr(held_out, name + "ABUSIVE"))
    wrong = sum(abuse.score_text(s)[0] >= abuse.THRESHOLD for s in getattr(held_out, name + "HARMLESS"))
    assert found >= 0.8 * len(getattr(held_out, name + "ABUSIVE")) and found >= 0.8 * (found + wrong)


def test_quotation_and_report_have_an_end():
    """A lone mark quotes nothing, a report ends with its clause, and a report isn't an excuse for who is addressed."""
    for text in ['5 "inch wide. You are an idiot.', "they removed my post, you worthless cretin", "that is a report that you are an idiot", 'He called it "fine"; you are a moron.']:
        assert abuse.score_text(text)[0] >= abuse.THRESHOLD
    for text in ['He wrote "you are an idiot" on a wall.', "The paper said that the man is an idiot.", "You are not an idiot.", "She never was a liar."]:
        assert abuse.score_text(text)[0] < abuse.THRESHOLD


def test_weights_add_up_along_the_composed_machine():
    automaton = abuse.Automaton([("x", 0.25, "@a be? @b")], {"a": ["0.5 CAP", "-1 CAP not"], "b": ["0.25 INSULT", "0.5 ADJ* INSULT"]})
    labels = lambda *words: [frozenset([w]) for w in words]
    for symbols, weight in [(labels("CAP", "INSULT"), 1.25), (labels("CAP", "be", "ADJ", "ADJ", "INSULT"), 1.25), (labels("CAP", "not", "be", "INSULT"), -0.5)]:
        state = 0
        for symbol in symbols:
            state = automaton.step(state, symbol)
        assert dict(automaton.outputs[state])[0] == weight


def test_documents_and_rates(spark):
    rows = [(1, ABUSIVE[0], "a", 9.0), (2, HARMLESS[0], "a", 9.0), (3, None, None, 9.0), (None, ABUSIVE[1], None, 9.0), (1, ABUSIVE[0], "a", 9.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, score double")
    scored = abuse.score_documents(df, "doc_id", "text", ["source"])
    assert scored.columns == ["doc_id", "source", "score", "kinds"] and scored.count() == 5
    assert {r["source"]: (r["n_documents"], r["n_abusive"], r["rate"]) for r in abuse.rates(scored, "source").collect()} == {"a": (3, 2, 0.666667), None: (2, 1, 0.5)}
    assert abuse.score_documents(df.limit(0), "doc_id", "text").count() == 0
