"""Descriptions of taxa in sentences: where they live, in what climate, on what ground.

Phrases are expressions over statistics, one row a taxon. Lists of places and of classes are bounded by their
dimension tables; only the grouping of classes into phrases is a Pandas UDF, on rows of one short array each.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lichen.functions.text import phrase

# The limits under which a phrase holds (last entry: beyond all of them).
SLOPES = [(3, "flat"), (8, "gentle"), (12, "moderate"), (18, "moderately steep"), (28, "steep")], "very steep"
COLD = [(-15, "extremely cold"), (-10, "incredibly cold"), (-5, "very cold"), (0, "cold"), (5, "cool"), (10, "temperate")], "warm"
RAIN = [(150, "extremely xeric"), (300, "xeric"), (450, "arid"), (600, "semi-arid"), (800, "subhumid"), (1100, "moderately wet"), (1500, "wet"), (2200, "very wet"), (3000, "extremely wet")], "torrential"
ACID = [(3.5, "ultra acidic"), (4.5, "extremely acidic"), (5.1, "very strongly acidic"), (5.6, "strongly acidic"), (6.1, "moderately acidic"), (6.6, "slightly acidic"), (7.4, "neutral"), (7.9, "slightly alkaline"), (8.5, "moderately alkaline")], "strongly alkaline"
SNOW = [(5, "snow-free"), (50, "slightly snowy"), (100, "moderately snowy"), (200, "snowy"), (300, "very snowy")], "incredibly snowy"
# Over which a phrase holds.
HEAT = ((34, "scorching"), (31, "very hot"), (29, "hot"), (27.5, "warm"), (25, "temperate"), (10, "cool"))
OFTEN = ((1.0, "almost always"), (0.8, "primarily"), (0.6, "commonly"), (0.4, "often"), (0.2, "sometimes"), (0.1, "uncommonly"), (0.05, "rarely"))
WINDS = ("north", "northeast", "east", "southeast", "south", "southwest", "west", "northwest")
ARTICLE = ("united states", "united kingdom", "netherlands", "philippines", "gambia")
TEXTURES = {"clay": "clay-rich", "loam": "loamy", "silt": "silty", "sand": "sandy"}
FOOT = 0.3048


def often(fraction: Column) -> Column:
    """How often, by the share; null under a twentieth."""
    return F.coalesce(*(F.when(fraction >= least, word) for least, word in OFTEN))


def heat(celsius: Column) -> Column:
    return F.when(celsius.isNotNull(), F.coalesce(*(F.when(celsius > over, word) for over, word in HEAT), F.lit("cold")))


def wind(degrees: Column) -> Column:
    """The compass point that a direction is nearest to."""
    return F.element_at(F.array(*map(F.lit, WINDS)), (F.floor(F.pmod(degrees, F.lit(360.0)) / 45 + 0.5) % 8 + 1).cast("int"))


def acidity(ph: Column) -> Column:
    return F.when(ph > 9.0, "very strongly alkaline").otherwise(phrase(ph, *ACID))


def coarseness(share: Column) -> Column:
    """Of soil, by its share of coarse fragments; null for what is neither."""
    return F.when(share < 2, "very fine").when(share < 5, "fine").when(share >= 25, "very coarse").when(share >= 15, "coarse")


def nutrients(nitrogen: Column) -> Column:
    return F.when(nitrogen < 1.5, "very nutrient poor").when(nitrogen < 2, "nutrient poor").when(nitrogen >= 10, "very nutrient rich").when(nitrogen >= 7, "nutrient rich")


def _filled(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def names(items: Column, last: bool | Column = True) -> Column:
    """"a", "a and b", "a, b, and c"; without ``last`` only commas."""
    n, front = F.size(items), F.array_join(F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))), ", ")
    whole = F.when(n == 1, F.element_at(items, 1)).when(n == 2, F.concat(front, F.lit(" and "), F.element_at(items, -1))).when(n > 2, F.concat(front, F.lit(", and "), F.element_at(items, -1))).otherwise("")
    last = F.lit(last) if isinstance(last, bool) else last
    return F.when(last, whole).otherwise(F.array_join(items, ", "))


def labels(items: Column) -> Column:
    """As ``names``, with semicolons where an item has a comma of its own."""
    comma = F.exists(items, lambda x: x.contains(","))
    front = F.array_join(F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))), "; ")
    return F.when(comma & (F.size(items) > 1), F.concat(front, F.lit("; and "), F.element_at(items, -1))).otherwise(names(items))


def with_article(name: Column) -> Column:
    n = F.trim(name)
    return F.when(~F.lower(n).startswith("the ") & F.lower(n).isin(*ARTICLE), F.concat(F.lit("the "), n)).otherwise(n)


def _line(body: Column, prefix: Column | None = None) -> Column:
    return F.when(body.isNotNull(), F.struct((prefix if prefix is not None else F.lit(None).cast("string")).alias("prefix"), body.alias("body")))


# terrain, weather, soil


def elevation_line(low: Column, high: Column, imperial: bool = False) -> Column:
    """Rounded to hundreds; to tens or ones where both ends would be the same; one height if they still are."""
    a, b = (low / FOOT, high / FOOT) if imperial else (low, high)
    unit = "ft" if imperial else "m"
    at = lambda v, step: F.bround(v / step, 0) * step
    text = lambda v: F.format_number(v, 0)
    spans = [F.when(at(a, s) != at(b, s), F.concat(F.lit("Found from "), text(at(a, s)), F.lit(" to "), text(at(b, s)), F.lit(f" {unit} elevation"))) for s in (100, 10, 1)]
    one = F.concat(F.lit("Found at "), text(F.bround(a, 0)), F.lit(f" {unit} elevation"))
    return F.when(low.isNotNull() & high.isNotNull(), F.coalesce(*spans, one))


def slope_line(mean: Column, tenth: Column) -> Column:
    most, least = phrase(mean, *SLOPES), phrase(F.coalesce(tenth, mean), *SLOPES)
    same = F.when(most == "flat", "flat areas").otherwise(F.concat(most, F.lit(" slopes")))
    span = F.concat(F.when(least == "flat", "flat areas").otherwise(least), F.lit(" to "), most, F.lit(" slopes"))
    return F.concat(F.lit("Often on "), F.when(least == most, same).otherwise(span))


def aspect_line(rbar: Column, mean: Column, count: Column, median_slope: Column) -> Column:
    """Only with more than 100 values that agree, on ground that slopes."""
    clear = (rbar > 0.15) & (count > 100) & (F.coalesce(median_slope, F.lit(0.0)) > 5)
    return F.when(clear, F.concat(F.when(rbar > 0.35, "Strongly prefers ").otherwise("Prefers "), wind(mean), F.lit("-facing slopes")))


def weather_lines(hottest: Column, coldest: Column, summer_rain: Column, winter_rain: Column, snow: Column, rain: Column) -> list[Column]:
    """Two texts: of summers and winters, and of the year's rain; null where nothing is known."""
    tier = phrase(snow, *SNOW)
    quarter = lambda mm: phrase(mm * 4, *RAIN)
    summer = _filled(heat(hottest), quarter(summer_rain))
    winter = _filled(phrase(coldest, *COLD), F.when(tier != "snow-free", tier).otherwise(quarter(winter_rain)))
    season = lambda parts, name: F.when(F.size(parts) > 0, F.concat(F.array_join(parts, ", "), F.lit(f" {name}")))
    both = _filled(season(summer, "summers"), season(winter, "winters"))
    return [F.when(F.size(both) > 0, F.concat(F.lit("Prefers "), F.array_join(both, " and "))), F.concat(F.lit("Typically "), phrase(rain, *RAIN), F.lit(" locations overall"))]


def soil_line(nitrogen: Column, ph: Column, salinity: Column) -> Column:
    parts = _filled(nutrients(nitrogen), acidity(ph), salinity)
    return F.when(F.size(parts) > 0, F.concat(F.lit("Usually "), labels(parts), F.lit(" soil")))


def texture_line(classes: Column, coarse: Column) -> Column:
    """From (name, fraction) with the largest first: the textures that are as frequent as the first, and the coarseness."""
    top = often(F.element_at(classes, 1)["fraction"])
    band = F.filter(classes, lambda c: often(c["fraction"]) == top)
    adjective = F.create_map(*(F.lit(x) for pair in TEXTURES.items() for x in pair))
    said = F.array_distinct(F.transform(band, lambda c: F.coalesce(adjective[F.lower(F.trim(c["name"]))], F.lower(F.trim(c["name"])))))
    texture = F.when((F.size(classes) > 0) & top.isNotNull(), labels(said))
    parts = _filled(coarse, texture)
    return F.when(F.size(parts) > 0, F.concat(F.lit("Prefers "), F.array_join(parts, ", "), F.lit(" soil")))


# places and regions


def _listed(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, gids, names): by falling count, then gid; a name that comes again is left out."""
    once = counts.groupBy(*by, "name").agg(F.min(F.struct((-F.col("n")).alias("n"), "gid")).alias("_k"))
    order = F.array_sort(F.collect_list(F.struct("_k", "name")))
    return once.groupBy(*by).agg(order.alias("_o")).select(*by, F.transform("_o", lambda x: x["_k"]["gid"]).alias("gids"), F.transform("_o", lambda x: x["name"]).alias("names"))


def _in(found: Column, parent: Column, more: str, limit: int) -> Column:
    some = names(F.slice(found, 1, limit), F.size(found) <= limit)
    return F.when(F.size(found) > limit, F.concat(some, F.lit(f" and other {more} in "), parent)).otherwise(F.concat(some, F.lit(" in "), parent))


def location_texts(counts: DataFrame, known: DataFrame, limit: int = 3) -> DataFrame:
    """(taxon_key, text) from counts (taxon_key, gid, n) and places (gid, level 0 to 2, name, parent_gid): the countries;
    where there is one, its regions; where that has one, its counties."""
    c = counts.where("n > 0").join(known.where("trim(name) <> ''").select("gid", "level", "name", "parent_gid"), "gid")
    top = _listed(c.where("level = 0"), ["taxon_key"]).select("taxon_key", F.col("gids").alias("g0"), F.col("names").alias("n0"))
    lower = [_listed(c.where(f"level = {k}"), ["taxon_key", "parent_gid"]).select(F.col("taxon_key").alias(f"t{k}"), F.col("parent_gid").alias(f"p{k}"), F.col("gids").alias(f"g{k}"), F.col("names").alias(f"n{k}")) for k in (1, 2)]
    j = top.join(lower[0], (F.size("g0") == 1) & (F.col("taxon_key") == F.col("t1")) & (F.element_at("g0", 1) == F.col("p1")), "left")
    j = j.join(lower[1], (F.size("g1") == 1) & (F.col("taxon_key") == F.col("t2")) & (F.element_at("g1", 1) == F.col("p2")), "left")
    country, state = with_article(F.element_at("n0", 1)), F.element_at("n1", 1)
    countries = F.transform(F.slice("n0", 1, limit), with_article)
    many = F.when(F.size("n0") > limit, F.concat(names(countries, False), F.lit(" and other countries"))).otherwise(names(countries))
    one = F.when(F.col("n1").isNull(), country).when(F.size("n1") > 1, _in(F.col("n1"), country, "regions", limit)).when(F.col("n2").isNotNull(), _in(F.col("n2"), state, "counties", limit)).otherwise(F.concat(state, F.lit(" in "), country))
    return j.select("taxon_key", F.when(F.size("n0") == 1, one).otherwise(many).alias("text"))


def location_texts_in(counts: DataFrame, known: DataFrame, gid: str, limit: int = 3) -> DataFrame:
    """(taxon_key, text) within one place: its regions or counties; of a county, where it lies."""
    place = known.where(F.col("gid") == gid).select("level", "name", "parent_gid").first()
    if place is None:
        return counts.limit(0).select("taxon_key", F.lit("").alias("text"))
    taxa, own = counts.select("taxon_key").distinct(), F.lit(place["name"])
    if place["level"] == 2:
        up = known.where(F.col("gid") == place["parent_gid"]).select("name").first()
        return taxa.select("taxon_key", F.concat(own, F.lit(f" in {up['name']}")).alias("text") if up else own.alias("text"))
    c = counts.where("n > 0").join(known.where("trim(name) <> ''").select("gid", "name", "parent_gid", "level"), "gid")
    inner = _listed(c.where((F.col("level") == place["level"] + 1) & (F.col("parent_gid") == gid)), ["taxon_key"])
    j = taxa.join(inner, "taxon_key", "left")
    if place["level"] == 1:
        return j.select("taxon_key", F.when(F.col("names").isNull(), own).otherwise(_in(F.col("names"), own, "subregions", limit)).alias("text"))
    below = _listed(c.where("level = 2"), ["taxon_key", "parent_gid"]).select(F.col("taxon_key").alias("t2"), F.col("parent_gid").alias("p2"), F.col("names").alias("n2"))
    j = j.join(below, (F.size("gids") == 1) & (F.col("taxon_key") == F.col("t2")) & (F.element_at("gids", 1) == F.col("p2")), "left")
    state = F.element_at("names", 1)
    one = F.when(F.col("n2").isNotNull(), _in(F.col("n2"), state, "counties", limit)).otherwise(state)
    many = _in(F.col("names"), with_article(own), "regions", limit)
    return j.select("taxon_key", F.when(F.col("names").isNull(), with_article(own)).when(F.size("names") == 1, one).otherwise(many).alias("text"))


def region_texts(fractions: DataFrame, legend: DataFrame, limit: int = 3, least: float = 0.05) -> DataFrame:
    """(taxon_key, text) of the commonest named classes from fractions (taxon_key, class, fraction); those under ``least`` count
    only as others, and a taxon without one above it has no row."""
    f = fractions.where("fraction > 0").join(legend.where("name IS NOT NULL AND name <> ''").select("class", "name"), "class")
    order = F.array_sort(F.collect_list(F.struct((-F.col("fraction")).alias("f"), "class", "name")))
    g = f.groupBy("taxon_key").agg(order.alias("o"))
    shown = F.transform(F.slice(F.filter("o", lambda x: -x["f"] >= least), 1, limit), lambda x: x["name"])
    g = g.select("taxon_key", shown.alias("s"), F.size("o").alias("n")).where(F.size("s") > 0)
    rest = F.col("n") > F.size("s")
    return g.select("taxon_key", F.concat(names(F.col("s"), ~rest), F.when(rest, " and other ecoregions").otherwise("")).alias("text"))


# classes in words


def _tier(fraction: float) -> int:
    """0 for the most frequent word; beyond all of them, their number."""
    return next((i for i, (least, _) in enumerate(OFTEN) if fraction >= least), len(OFTEN))


def _spoken(items: list[str]) -> str:
    mark = ";" if len(items) > 1 and any("," in x for x in items) else ","
    if len(items) < 3:
        return (f"{mark} and " if mark == ";" else " and ").join(items)
    return f"{mark} ".join(items[:-1]) + f"{mark} and {items[-1]}"


class Wording:
    """How the classes of a legend are put into words.

    ``legend``: dicts of id and either group, label, solo and attributes, or memberships, a list of such: a class of several
    groups counts for each in full. ``axes``: for a group, lists of attributes that exclude each other; one is said where
    all classes of the group that are mentioned agree on it."""

    def __init__(self, legend: Iterable[dict], axes: dict[str, list[list[str]]] | None = None, suffix: str = "", share: bool = False) -> None:
        low = lambda x: str(x or "").strip().lower()
        self.parts: dict[int, list[tuple[str, str, str, tuple[str, ...]]]] = {}
        for c in legend:
            own = [(low(m.get("group")), low(m.get("label") or m.get("group")), low(m.get("solo")), tuple(sorted(low(a) for a in m.get("attributes") or () if low(a)))) for m in c.get("memberships") or [c]]
            self.parts[int(c["id"])] = [p for p in own if p[0]]
        self.axes, self.suffix, self.share = axes or {}, suffix, share

    def lines(self, fractions: dict[int, float]) -> list[tuple[str, str]]:
        """At most two (prefix, body): what is as frequent as the commonest, then the next."""
        weight: dict[tuple, float] = {}
        said: dict[tuple, tuple] = {}
        several = False
        for k, own in self.parts.items():
            x = fractions.get(k, 0.0)
            if x > 0:
                several |= len(own) > 1
                for p in own:
                    weight[(p[0], p[3])] = weight.get((p[0], p[3]), 0.0) + x
                    said.setdefault((p[0], p[3]), p)
        left = sorted(weight, key=lambda k: -weight[k])
        kinds: dict[str, int] = {}
        for g, _ in weight:
            kinds[g] = kinds.get(g, 0) + 1
        out: list[tuple[int, list[tuple]]] = []
        while left and len(out) < 2 and (tier := _tier(weight[left[0]])) < len(OFTEN):
            band = [k for k in left if _tier(weight[k]) == tier]
            left = [k for k in left if k not in band]
            own = tier if several else _tier(sum(weight[k] for k in band))
            if out and own <= out[-1][0]:  # as frequent as the line before: one line
                band = out[-1][1] + band
                own = tier if several else _tier(sum(weight[k] for k in band))
                out[-1] = (own, band)
            else:
                out.append((own, band))
        return [(f"{OFTEN[t][1].capitalize()} in", self._body(band, weight, said, kinds) + self.suffix) for t, band in out]

    def _body(self, band: list[tuple], weight: dict, said: dict, kinds: dict[str, int]) -> str:
        groups: dict[str, list[tuple]] = {}
        for k in sorted(band, key=lambda k: -weight[k]):
            groups.setdefault(k[0], []).append(k)
        order = sorted(groups, key=lambda g: -sum(weight[k] for k in groups[g]))
        pairs = [self._stem(groups[g], said, kinds[g]) for g in order]
        if self.share:  # groups with the same adjective say it once
            by: dict[str, list[str]] = {}
            for adjective, label in pairs:
                by.setdefault(adjective, []).append(label)
            pairs = [(a, _spoken(x)) for a, x in by.items()]
        return _spoken([f"{a} {label}" if a else label for a, label in pairs])

    def _stem(self, keys: list[tuple], said: dict, kinds: int) -> tuple[str, str]:
        first = said[keys[0]]
        if len(keys) == 1 and first[2]:
            return "", first[2]
        axes = self.axes.get(keys[0][0])
        if axes:
            kept = []
            for axis in axes:
                values = {next((a for a in k[1] if a in axis), None) for k in keys}
                if len(values) == 1 and None not in values:
                    kept += values
            return " ".join(kept), first[1]
        every = [a for k in keys for a in k[1]]
        return ("" if not every or 1 < len(keys) == kinds else _spoken(every)), first[1]


def class_lines(fractions: DataFrame, wording: Wording) -> DataFrame:
    """(taxon_key, lines: array<struct<prefix, body>>) from fractions (taxon_key, class, fraction)."""
    g = fractions.where("fraction > 0").groupBy("taxon_key").agg(F.array_sort(F.collect_list(F.struct("class", "fraction"))).alias("f"))

    @F.pandas_udf("array<struct<prefix: string, body: string>>")
    def said(rows: pd.Series) -> pd.Series:
        return rows.map(lambda f: [{"prefix": a, "body": b} for a, b in wording.lines({int(x["class"]): float(x["fraction"]) for x in f})])

    return g.select("taxon_key", said("f").alias("lines"))


# Sections of a profile in their order, with titles.
SECTIONS = {"locations": "Locations", "climate": "Climates", "biomes": "Biomes", "habitat": "Habitat", "terrain": "Terrain", "weather": "Weather", "soil": "Soil"}


def text_lines(*texts: Column) -> Column:
    """Texts as lines without a prefix; nulls are left out."""
    return F.filter(F.array(*(_line(t) for t in texts)), lambda x: x.isNotNull())


def profile(taxa: DataFrame, sections: dict[str, DataFrame]) -> DataFrame:
    """(taxon_key, sections): for each taxon, in the fixed order, the sections (taxon_key, lines) that have lines."""
    out = taxa.select("taxon_key")
    for name in SECTIONS:
        if name in sections:
            out = out.join(sections[name].select("taxon_key", F.col("lines").alias(name)), "taxon_key", "left")
    every = F.array(*(F.struct(F.lit(n).alias("id"), F.lit(t).alias("title"), F.col(n).alias("lines")) for n, t in SECTIONS.items() if n in sections))
    return out.select("taxon_key", F.filter(every, lambda s: F.coalesce(F.size(s["lines"]) > 0, F.lit(False))).alias("sections"))
