"""Offline gazetteer: loading, lookup by name, nearest place, places in text, and the resolution ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..session import cut_lineage
from .spatial import nearest_within, usable_location

#: Inhabitants from which a bare capitalised word may be a place.
BARE_CITY = 200_000
#: Radius in kilometres within which a precise location takes the name of a place.
NAME_RADIUS_KM = {"exact": 100.0, "city": 200.0, "admin1": 600.0}
BODY_CHARACTERS = 600
CANDIDATES_A_NAME = 12
#: Inhabitants from which a place overrules what an extractor takes a name for.
KNOWN_CITY = 100_000
# What countries are called in reports, by their code.
COUNTRY_ALIASES = {
    "US": "united states, united states of america, usa, america, the us, u s", "GB": "united kingdom, uk, britain, great britain, england, scotland, wales, northern ireland", "KR": "south korea", "KP": "north korea", "ZA": "south africa",
    "SS": "south sudan", "RU": "russia, russian federation", "IR": "iran", "SY": "syria", "VN": "vietnam", "LA": "laos, laosia", "MM": "myanmar, burma", "TZ": "tanzania", "VE": "venezuela", "BO": "bolivia", "MD": "moldova", "CZ": "czechia, czech republic",
    "TR": "turkiye, turkey", "CI": "ivory coast, cote divoire", "CV": "cape verde", "CD": "democratic republic of the congo, dr congo, congo", "CG": "republic of the congo", "PS": "palestine, gaza, gaza strip, west bank", "NL": "the netherlands, holland",
    "MK": "macedonia, north macedonia", "SZ": "eswatini, swaziland", "TW": "taiwan", "HK": "hong kong", "AE": "united arab emirates, uae", "SA": "saudi arabia", "LK": "sri lanka", "NZ": "new zealand", "PG": "papua new guinea", "CR": "costa rica",
    "DO": "dominican republic", "SV": "el salvador", "PR": "puerto rico", "BN": "brunei", "TL": "east timor, timor leste",
}


def read_places(lines: DataFrame) -> DataFrame:
    """Places of a tab-separated dump (``value`` lines); comments and rows of fewer than 15 fields are skipped."""
    f = lines.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 15)
    population = F.when(F.size("f") >= 19, F.col("f")[14]).otherwise(F.col("f")[13])
    return f.select(
        F.col("f")[0].try_cast("bigint").alias("geoname_id"), F.col("f")[1].alias("name"), F.col("f")[2].alias("asciiname"), F.nullif(F.col("f")[3], F.lit("")).alias("alternatenames"), F.col("f")[4].try_cast("double").alias("lat"),
        F.col("f")[5].try_cast("double").alias("lon"), F.col("f")[7].alias("feature_code"), F.col("f")[8].alias("country_code"), F.col("f")[10].alias("admin1"), F.coalesce(population.try_cast("bigint"), F.lit(0)).alias("population"),
    ).where("geoname_id is not null and lat is not null and lon is not null")


def read_countries(lines: DataFrame) -> DataFrame:
    """iso2, iso3, fips and name of a tab-separated country list."""
    f = lines.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("f")).where(F.size("f") >= 5)
    return f.select(F.col("f")[0].alias("iso2"), F.col("f")[1].alias("iso3"), F.nullif(F.col("f")[3], F.lit("")).alias("fips"), F.col("f")[4].alias("name")).where("iso2 <> ''")


def place_names(places: DataFrame) -> DataFrame:
    """norm, is_primary and the place of every name; short alternates and stop words are not names.

    The candidates of a name are ranked by population, then primary names first; 12 are kept.
    """
    some = lambda c: F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda n: F.struct(n.alias("n"), F.lit(False).alias("p")))
    own = F.array(F.struct(F.col("name").alias("n"), F.lit(True).alias("p")), F.struct(F.col("asciiname").alias("n"), F.lit(True).alias("p")))
    names = places.select("geoname_id", "name", "lat", "lon", "country_code", "population", F.explode(F.concat(own, some(F.col("alternatenames")))).alias("a"))
    norm = text.normalize_key(F.col("a.n"))
    names = names.select(norm.alias("norm"), F.col("a.p").alias("is_primary"), "geoname_id", "name", "lat", "lon", "country_code", "population")
    names = names.where((F.col("norm") != "") & (F.col("is_primary") | ((F.length("norm") >= 5) & ~F.col("norm").isin(text.STOPWORDS))))
    names = names.groupBy("norm", "geoname_id", "name", "lat", "lon", "country_code", "population").agg(F.max("is_primary").alias("is_primary"))
    order = Window.partitionBy("norm").orderBy(F.desc("population"), F.desc("is_primary"), "geoname_id")
    return names.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= CANDIDATES_A_NAME)


def known_names(places: DataFrame, countries: DataFrame) -> DataFrame:
    """``norm`` of the names that overrule an extractor: countries, and places of at least KNOWN_CITY inhabitants (the first of a name counts)."""
    large = place_names(places).where((F.col("rank") == 1) & (F.col("population") >= KNOWN_CITY)).select("norm")
    return large.unionByName(country_names(countries).select("norm")).distinct()


def country_names(countries: DataFrame) -> DataFrame:
    """``norm`` and ``land`` (two letters) of countries by their names, then by what they are called in reports; no alias hides a name."""
    spark = countries.sparkSession
    own = countries.select(text.normalize_key(F.col("name")).alias("norm"), F.col("iso2").alias("land"), F.lit(0).alias("o")).where("norm <> ''")
    called = spark.createDataFrame([(alias, code, 1) for code, names in COUNTRY_ALIASES.items() for alias in names.split(", ")], "norm string, land string, o int")
    listed = called.join(countries.select(F.col("iso2").alias("land")).distinct(), "land", "left_semi").select("norm", "land", "o")
    return own.unionByName(listed).groupBy("norm").agg(F.min_by("land", F.struct("o", "land")).alias("land"))


def statistics(places: DataFrame, countries: DataFrame) -> DataFrame:
    """One row: number of places, of distinct names and of countries."""
    one = F.lit(1).alias("one")
    counted = places.agg(F.count(F.lit(1)).alias("places"), one)
    names = place_names(places).agg(F.count_distinct("norm").alias("names"), one)
    return counted.join(names, "one").join(countries.where("iso2 <> ''").agg(F.count_distinct("iso2").alias("countries"), one), "one").drop("one")


def places_in_text(df: DataFrame, key: str, column: str, names: DataFrame, countries: DataFrame) -> DataFrame:
    """``key`` and ``place`` of the texts that name a place; those that name only a country give no row."""
    return scan_text(df, key, column, names, countries).where("kind = 'place'").select(key, "place")


def find_places(df: DataFrame, key: str, name: str, country: str | None, names: DataFrame) -> DataFrame:
    """``key`` and ``place`` (a struct) for the names that are known: in the preferred country if it has one."""
    columns = ["geoname_id", "name", "lat", "lon", "country_code", "population"]
    asked = df.select(F.col(key), text.normalize_key(F.col(name)).alias("norm"), (F.col(country) if country else F.lit(None).cast("string")).alias("wish")).where("norm <> ''")
    hits = asked.join(names, "norm")
    best = F.min_by(F.struct(*columns), F.struct(F.coalesce(F.col("country_code") != F.col("wish"), F.lit(False)), "rank"))
    return hits.groupBy(key).agg(best.alias("place"))


def nearest_place(points: DataFrame, key: str, places: DataFrame, km: float) -> DataFrame:
    """``key``, ``geoname_id`` and ``distance_km`` of the nearest place within ``km``; ties by id."""
    return nearest_within(points.select(F.col(key), "lat", "lon"), places.select("geoname_id", "lat", "lon"), key, "geoname_id", km)


def spans(words: Column) -> Column:
    """Runs of four to one capitalised words of an array of struct(raw, norm): struct(at, n, norm)."""

    def runs_of(n: int) -> Column:
        part = lambda i: F.slice(words, i + 1, n)
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))),
            lambda i: F.struct(
                i.alias("at"), F.lit(n).alias("n"), F.array_join(F.transform(part(i), lambda w: w["norm"]), " ").alias("norm"), F.forall(part(i), lambda w: text.is_capitalised(w["raw"])).alias("good"), (F.size(part(i)) == n).alias("whole")
            ),
        )

    runs = [runs_of(n) for n in (4, 3, 2, 1)]
    return F.filter(F.concat(*runs), lambda s: s["good"] & s["whole"])


def scan_text(df: DataFrame, key: str, column: str, names: DataFrame, countries: DataFrame) -> DataFrame:
    """``key`` and ``kind`` (place or country), ``place``, ``country_code`` of what a text names.

    The longest primary name of several words comes first, then the first country, then the most populous
    city among single words that is large and no stop word. Texts that name nothing give no row.
    """
    words = df.select(F.col(key), text.cased_tokens(F.col(column)).alias("w")).where(F.size("w") > 0)
    found = words.select(key, F.explode(spans(F.col("w"))).alias("s")).select(key, "s.at", "s.n", "s.norm")
    place = F.struct("geoname_id", "name", "lat", "lon", "country_code", "population")
    top = names.where("rank = 1").select("norm", "is_primary", "population", place.alias("place"))
    lands = country_names(countries)
    hits = found.join(top, "norm", "left").join(lands, "norm", "left").where("place is not null or land is not null")
    many = F.when(F.col("place").isNotNull() & F.col("is_primary") & (F.col("n") > 1), F.struct("n", -F.col("at")))
    bare = F.when(F.col("place").isNotNull() & (F.col("n") == 1) & (F.col("population") >= BARE_CITY) & ~F.col("norm").isin(text.STOPWORDS), F.struct("population", -F.col("at")))
    best = hits.groupBy(key).agg(
        F.max_by("place", many).alias("many"), F.max(many).alias("has_many"), F.min_by("land", F.when(F.col("land").isNotNull(), F.struct("at", -F.col("n")))).alias("land"), F.max_by("place", bare).alias("bare"), F.max(bare).alias("has_bare")
    )
    chosen = F.when(F.col("has_many").isNotNull(), F.struct(F.lit("place").alias("kind"), F.col("many").alias("place"), F.col("many.country_code").alias("country_code"))).when(
        F.col("land").isNotNull(), F.struct(F.lit("country").alias("kind"), F.lit(None).cast(top.schema["place"].dataType).alias("place"), F.col("land").alias("country_code"))
    )
    chosen = chosen.when(F.col("has_bare").isNotNull(), F.struct(F.lit("place").alias("kind"), F.col("bare").alias("place"), F.col("bare.country_code").alias("country_code")))
    return best.select(key, chosen.alias("c")).where("c is not null").select(key, "c.kind", "c.place", "c.country_code")


def country_centres(places: DataFrame) -> DataFrame:
    """country_code, lat, lon: means weighted by population."""
    mean = lambda c: (F.sum(F.col(c) * F.greatest("population", F.lit(1))) / F.sum(F.greatest("population", F.lit(1)))).alias(c)
    return places.where("country_code is not null").groupBy("country_code").agg(mean("lat"), mean("lon"))


def resolve_locations(drafts: DataFrame, places: DataFrame, countries: DataFrame) -> DataFrame:
    """id, lat, lon, precision, place_name, country_code and step for every draft, by a ladder of evidence.

    (1) the source's own coordinates; (2) the place hint, then its parts, as a city; (3) a place in the title;
    (4) a place in the first 600 characters of the body, if the title names no other country; (5) the centre of the country that the
    title or body names; (6) the centre of the country of a FIPS code. Otherwise everything is null.
    ``drafts``: id, title, body, place_hint, lat, lon, geo_precision, country_code, fips.
    """
    names = place_names(places)
    d = drafts.withColumn("own", usable_location(F.col("lat"), F.col("lon")))
    hinted = d.select("id", F.explode(F.concat(F.array("place_hint"), F.split("place_hint", r"[,;|]"))).alias("part"), "country_code")
    hinted = hinted.withColumn("order", F.monotonically_increasing_id())
    by_part = find_places(hinted.withColumn("rowkey", F.struct("id", "order")), "rowkey", "part", "country_code", names)
    hint = by_part.groupBy(F.col("rowkey.id").alias("id")).agg(F.min_by("place", "rowkey.order").alias("hint"))
    title = scan_text(d, "id", "title", names, countries).select("id", F.col("kind").alias("t_kind"), F.col("place").alias("t_place"), F.col("country_code").alias("t_country"))
    body = scan_text(d.withColumn("body", F.substring("body", 1, BODY_CHARACTERS)), "id", "body", names, countries).select("id", F.col("kind").alias("b_kind"), F.col("place").alias("b_place"), F.col("country_code").alias("b_country"))
    joined = d.join(hint, "id", "left").join(title, "id", "left").join(body, "id", "left")
    agrees = F.col("t_country").isNull() | (F.col("t_country") == F.col("b_country"))
    city = F.when(F.col("own").isNull(), F.coalesce("hint", F.when(F.col("t_kind") == "place", F.col("t_place")), F.when((F.col("b_kind") == "place") & agrees, F.col("b_place"))))
    fips = countries.where("fips is not null").select("fips", F.col("iso2").alias("f_country")).dropDuplicates(["fips"])
    joined = joined.withColumn("city", city).join(fips, "fips", "left")
    land = F.coalesce("t_country", F.when(F.col("b_kind") == "country", F.col("b_country")), "f_country")
    centres = country_centres(places).select(F.col("country_code").alias("land"), F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    joined = joined.withColumn("land", F.when(F.col("own").isNull() & F.col("city").isNull(), land)).join(centres, "land", "left")
    step = (
        F.when(F.col("own").isNotNull(), "source").when(F.col("city").isNull() & F.col("c_lat").isNull(), None).when(F.col("city").isNull(), F.when(F.coalesce("t_country", "b_country").isNotNull(), "country").otherwise("code"))
        .when(F.col("hint").isNotNull(), "hint").when(F.col("t_kind") == "place", "title").otherwise("body")
    )
    precision = F.when(step == "source", F.coalesce("geo_precision", F.lit("exact"))).when(F.col("city").isNotNull(), "city").when(F.col("c_lat").isNotNull(), "country")
    return joined.select(
        "id", F.coalesce("own.lat", "city.lat", "c_lat").alias("lat"), F.coalesce("own.lon", "city.lon", "c_lon").alias("lon"), precision.alias("precision"), F.col("city.name").alias("place_name"),
        F.coalesce(F.when(F.col("own").isNotNull(), F.col("country_code")), "city.country_code", F.when(F.col("c_lat").isNotNull(), F.col("land"))).alias("country_code"), step.alias("step"),
    )


def name_precise(resolved: DataFrame, places: DataFrame) -> DataFrame:
    """Fills place_name and country_code of located rows without a name from the nearest place in reach of their precision.

    The rows are materialised once, as the join looks at them several times.
    """
    resolved = cut_lineage(resolved)
    open_rows = resolved.where("place_name is null and lat is not null")
    known = places.select("geoname_id", F.col("name").alias("near_name"), F.col("country_code").alias("near_country"))
    parts = None
    for precision, km in NAME_RADIUS_KM.items():
        part = nearest_place(open_rows.where(F.col("precision") == precision), "id", places, km)
        parts = part if parts is None else parts.unionByName(part)
    named = parts.join(known, "geoname_id").select("id", "near_name", "near_country")
    return resolved.join(named, "id", "left").withColumns({"place_name": F.coalesce("place_name", "near_name"), "country_code": F.coalesce("country_code", "near_country")}).drop("near_name", "near_country")
