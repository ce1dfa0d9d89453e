"""Secret scans with DataFrame functions only.

Three base patterns are matched leftmost and without overlaps; the text between matches and the matches themselves give
their places as running sums of lengths. Further spans come from two character Markov models, one of random
strings and one of ordinary identifiers, trained from labelled samples: a run of key characters is a secret when the
log-likelihood ratio of its transitions is high enough in total and a step. Base spans are cut out of a run first, and each
piece of 16 characters or more that is left counts as a run. The trained table of log-ratios is a
literal in the plan, so scoring stays in the JVM.

Defined cases: null text is empty; an empty text has no spans, and the digest of nothing; a null doc_id stays null; rows
that repeat are scanned alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import math
import random
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lichen.llm._shared import plain

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"  # the longest run after AKIA, in all of 20 characters or more
HEX = "[0-9a-f]{24,}"
KEYLIKE = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "model")
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST_TOTAL, LEAST_STEP = 12.0, 0.5
STEP = 128
NONE = "cast(array() as array<struct<start:int,order:int,end:int>>)"


def samples(seed: int = 7, n: int = 4000) -> list[tuple[str, bool]]:
    """Labelled strings: random keys (True) of several alphabets, and ordinary identifiers (False)."""
    r = random.Random(seed)
    base = "access account active address alpha application array async back base batch before begin block buffer build button cache call change channel check class clear client close cluster code column command common compare config connect content context control copy count create current cursor data date debug default delete depth detail device direct display document domain download driver edit element email enable end engine entry error event exception expect export express factory feature field file filter final find first float flow folder format forward frame function general get global graph group handle hash header height hidden history host image import index info init input insert instance integer internal item iterator join key label language last layer layout length level library limit line link list load local lock log long lookup machine main manager map mask match max member memory menu merge message method min mode model module monitor name network next node normal notify number object offset open operator option order output owner package page panel parent parse part password path pattern payload pending phase pixel plan player point policy pool port position post prefix previous print process product profile project property protocol provider proxy public query queue random range rate read receive record reference region register release remote remove render replace report request reset resource response result return role root route row rule run sample save scale schema scope screen search second section select send sequence server service session set shape shared signal simple single size source space split stack start state static status step storage store stream string style submit suffix sum support switch symbol system table target task template test text theme thread time title token total trace track transaction transfer tree trigger type union unique unit update upload user utility valid value variable vector version view visible wait weight width window word worker write zone the and that with from this have not are was for you they which their would there about other into than then them these some could like der und die das nicht ein eine mit auf schaft ung lich que los las una para por con como est les des une dans pour avec tion ment".split()
    out = []
    for i in range(n):
        kind = i % 4
        size = r.randint(16, 64)
        if kind == 0:
            out.append(("".join(r.choices("0123456789abcdef", k=size)), True))
        elif kind == 1:
            out.append((base64.b64encode(r.randbytes(size * 3 // 4 + 1)).decode(), True))
        elif kind == 2:
            out.append(("".join(r.choices(SYMBOLS[:62], k=size)), True))
        else:
            out.append(("".join(r.choices(SYMBOLS[26:62], k=size)), True))
        words = r.choices(base, k=r.randint(2, 6))
        form = r.randint(0, 4)
        joined = ["_".join(words), "-".join(words), "".join(w.capitalize() for w in words), words[0] + "".join(w.capitalize() for w in words[1:]), "".join(words)][form]
        out.append((joined.upper() if r.random() < 0.08 else joined + (str(r.randint(0, 2030)) if r.random() < 0.15 else ""), False))
    return out


def log_ratios(labelled: Iterable[tuple[str, bool]]) -> list[float]:
    """For each pair of symbols, the log of its transition's likelihood in random strings over that in identifiers."""
    k = len(SYMBOLS)
    counts = [[1.0] * (k * k), [0.2] * (k * k)]
    for text, secret in labelled:
        own = counts[0 if secret else 1]
        for a, b in zip(text, text[1:], strict=False):
            own[SYMBOLS.index(a) * k + SYMBOLS.index(b)] += 1
    out = []
    for a in range(k):
        totals = [sum(c[a * k : a * k + k]) for c in counts]
        out += [math.log(counts[0][a * k + b] / totals[0]) - math.log(counts[1][a * k + b] / totals[1]) for b in range(k)]
    return out


def _running(items: Column, length: Callable[[Column], Column], spans: Callable[[Column, Column], Column]) -> Column:
    """All spans(start, item), where an item starts at the sum of the lengths before it.

    Items are walked ``STEP`` at a time and their spans then moved, so that no array grows item by item to the length of a
    text: the work is in proportion to items times STEP."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / STEP).cast("int")), lambda i: F.slice(items, i * STEP + 1, STEP))
    zero = F.struct(F.lit(0).alias("at"), F.expr(NONE).alias("out"))
    step = lambda acc, x: F.struct((acc["at"] + length(x)).alias("at"), F.concat(acc["out"], spans(acc["at"], x)).alias("out"))
    walked = F.transform(chunks, lambda c: F.aggregate(c, zero, step))
    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    starts = lambda w: F.aggregate(w, begin, lambda acc, x: F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
    moved = lambda w, at: F.transform(w["out"], lambda s: F.struct((s["start"] + at).alias("start"), s["order"].alias("order"), (s["end"] + at).alias("end")))
    # walked is taken once, as the one element of an array
    return F.flatten(F.element_at(F.transform(F.array(walked), lambda w: F.zip_with(w, starts(w), moved)), 1))


def _places(text: Column, pattern: str, kind: str, value: int, least: int) -> Column:
    """array<struct<start, order, end>> of the matches whose group ``value`` has ``least`` characters or more."""
    p = F.lit(pattern)
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("all"), F.regexp_extract_all(text, p, F.lit(value)).alias("own"))
    span = lambda start, x: F.array(F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("order"), (start + F.length(x["all"])).alias("end")))
    none = F.expr(NONE)
    spans = lambda at, x: F.when(F.coalesce(F.length(x["own"]) >= least, F.lit(False)), span(at + F.length(x["gap"]), x)).otherwise(none)
    walk = _running(found, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["all"]), F.lit(0)), spans)
    return F.when(F.rlike(text, p), walk).otherwise(none)


def _outside(run: Column, blocks: Column) -> Column:
    """The pieces of a run between the base spans, those of 16 characters or more. ``blocks`` are base spans in their order,
    STEP at a time, each with the place where the first begins and the last ends: only those that meet the run are looked through."""
    piece = lambda start, end: F.when(end - start >= 16, F.array(F.struct(start.alias("start"), run["order"].alias("order"), end.alias("end")))).otherwise(F.expr(NONE))
    near = F.flatten(F.transform(F.filter(blocks, lambda b: (b["first"] < run["end"]) & (run["start"] < b["last"])), lambda b: b["spans"]))
    within = F.filter(near, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    cut = F.aggregate(
        within,
        F.struct(run["start"].alias("at"), F.expr(NONE).alias("out")),
        lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), F.concat(acc["out"], piece(acc["at"], b["start"])).alias("out")),
        lambda acc: F.concat(acc["out"], piece(acc["at"], run["end"])),
    )
    return F.when(F.size(within) > 0, cut).otherwise(F.array(run))


def _blocks(spans: Column) -> Column:
    """Sorted spans, STEP at a time: array<struct<first, last, spans>>."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / STEP).cast("int")), lambda i: F.slice(spans, i * STEP + 1, STEP))
    bounded = lambda s: F.struct(F.element_at(s, 1)["start"].alias("first"), F.array_max(F.transform(s, lambda x: x["end"])).alias("last"), s.alias("spans"))
    return F.when(F.size(spans) > 0, F.transform(parts, bounded)).otherwise(F.expr("cast(array() as array<struct<first:int,last:int,spans:array<struct<start:int,order:int,end:int>>>>)"))


def _ratio(run: Column, table: Column, code: Column) -> Column:
    """The log-likelihood ratio of a run of key characters."""
    codes = F.transform(F.split(run, ""), lambda c: F.element_at(code, F.ascii(c) + 1))
    pairs = F.zip_with(F.slice(codes, 1, F.length(run) - 1), F.slice(codes, 2, F.length(run) - 1), lambda a, b: F.element_at(table, a * len(SYMBOLS) + b + 1))
    return F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x)


def find_secrets(docs: DataFrame, labelled: Iterable[tuple[str, bool]] | None = None) -> DataFrame:
    """(doc_id, text, base, added): spans as array<struct<start, order, end>>, both in the order of the contract."""
    ratios = log_ratios(samples() if labelled is None else labelled)
    table = F.expr("cast(split('" + ",".join(f"{x:.5f}" for x in ratios) + "', ',') as array<double>)")
    code = F.expr("cast(split('" + ",".join(str(max(0, SYMBOLS.find(chr(i)))) for i in range(128)) + "', ',') as array<int>)")
    text = F.col("text")
    base = F.concat(_places(text, ASSIGN, "assign", 2, 6), _places(text, ACCESS, "access", 0, 20), _places(text, HEX, "hex", 0, 24))
    d = plain(docs).withColumn("base", F.array_sort(base)).withColumn("runs", _places(text, KEYLIKE, "model", 0, 16))
    free = F.flatten(F.element_at(F.transform(F.array(_blocks(F.col("base"))), lambda b: F.transform("runs", lambda r: _outside(r, b))), 1))
    steps = lambda m: m["end"] - m["start"] - 1

    def secret(m: Column) -> Column:
        r = _ratio(F.substring(text, m["start"] + 1, m["end"] - m["start"]), table, code)
        return (r >= LEAST_TOTAL) & (r >= LEAST_STEP * steps(m))

    return d.withColumn("added", F.when(F.size("runs") > 0, F.filter(free, secret)).otherwise(F.col("runs"))).drop("runs")


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["order"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans by kind, their digest, and all spans of every document."""
    d = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["order"] == k)).cast("long")
    every = F.array_sort(F.concat("base", "added"))
    return d.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(every).alias("spans"))
