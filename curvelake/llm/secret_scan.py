"""Secret scan: three base patterns, and character Markov models that tell random strings from ordinary identifiers.

Method: two first-order Markov chains over character classes' letters (ALPHABET), one trained on labelled random strings, one on labelled
ordinary identifiers. A candidate is a run of at least MIN_CANDIDATE characters of ALPHABET; its score is the mean log-likelihood ratio of the two
chains per transition. Candidates over the threshold that touch no base span are added as kind "markov". Of a candidate that is not over it as a whole,
as where a key is glued to a path or a name, those parts between separators are that are; where none is, its best window (of the largest sum of ratios
less the threshold, from where it first reaches zero), if that is as long as a candidate must be.
Both training sets are made by rule (digests of counters; words joined in the ways of identifiers), with their labels known by construction,
and the table of ratios is fitted on the driver: its size is fixed. Everything on the executors is SQL functions.

Positions come from splitting the text at the pattern: the parts between the matches and the matches alternate, so their lengths add up to
code-point offsets. Split and extract use the same matcher, leftmost and non-overlapping. The work grows with the text's length, and with the logarithm of the number of its matches:
characters are split once and looked up by index, offsets are summed in chunks, and what touches a base span is found by halving.

Cases: a null text counts as empty; an empty text has no spans, an empty string of spans and the digest of the empty string. Texts of any
length are scanned whole. Repeated rows give repeated results; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, numbers, text_or_empty

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
MIN_CANDIDATE = 16
THRESHOLD = 0.6
#: Matches that a fold gathers at once.
CHUNK = 64

#: kind -> (pattern, group that is measured, characters it needs)
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    # Runs of hex digits are maximal, so asking for 24 in the pattern drops just those that are too short.
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: A cheap test that a text can match at all.
MAY = {"assign": r"(?i:passw|secret|token|api_?key)", "access": "AKIA", "hex": r"[0-9a-f]{24}"}
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{MIN_CANDIDATE},}}"
#: What lies between separators.
PART = rf"[A-Za-z0-9+]{{{MIN_CANDIDATE},}}"
KINDS = [*BASE, "markov"]

WORDS = "get set user name value count index list item file path read write open close buffer size data text line word page host port time date start end first last next node tree map key table column row query result error message handler service client server request response config option default parse format print load store cache queue stack thread process event state model view test case build version number string array object class method field type".split()


def samples(n: int = 2000) -> tuple[list[str], list[str]]:
    """Labelled samples: random strings (hex, base64-like, upper-case keys) and ordinary identifiers (words joined, a number at the end of some)."""
    import base64

    random, plain = [], []
    for i in range(n):
        d = hashlib.sha256(f"random {i}".encode()).digest()
        random.append((d.hex(), base64.b64encode(d).decode(), base64.b32encode(d).decode().rstrip("="))[i % 3])
        e = hashlib.sha256(f"plain {i}".encode()).digest()
        ws = [WORDS[e[k] % len(WORDS)] for k in range(2 + e[8] % 4)]
        joined = ("_".join(ws), ws[0] + "".join(w.capitalize() for w in ws[1:]), "-".join(ws), "".join(w.capitalize() for w in ws), "_".join(ws).upper(), "/".join(ws))[i % 6]
        plain.append(joined + (("_" if i % 2 else "") + str(e[9] % 100) if e[10] % 3 == 0 else ""))
    return random, plain


def log_ratios(random: list[str], plain: list[str], smooth: float = 0.5) -> list[float]:
    """For each pair of characters log P(second | first) under the random chain less that under the identifier chain."""
    k = len(ALPHABET)

    def chain(strings: list[str]) -> list[float]:
        counts = [smooth] * (k * k)
        for s in strings:
            for a, b in zip(s, s[1:]):
                counts[ALPHABET.index(a) * k + ALPHABET.index(b)] += 1
        rows = [sum(counts[a * k : a * k + k]) for a in range(k)]
        return [math.log(c / rows[i // k]) for i, c in enumerate(counts)]

    return [round(a - b, 4) for a, b in zip(chain(random), chain(plain))]


def _gains(s: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of each transition of a string over ALPHABET."""
    table, k = numbers(ratios), len(ALPHABET)
    codes = F.transform(F.split(s, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    return let(codes, lambda c: F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.element_at(table, F.element_at(c, i) * k + F.element_at(c, i + 1) + 1)))


def llr(s: Column, ratios: list[float]) -> Column:
    """Mean log-likelihood ratio per transition of a string over ALPHABET, of two characters or more."""
    return F.aggregate(_gains(s, ratios), F.lit(0.0), lambda a, x: a + x) / (F.length(s) - 1)


def best_window(s: Column, ratios: list[float], threshold: float) -> Column:
    """struct<from, to>, in characters from 0, of the stretch of a string whose transitions' ratios, less the threshold each, have the largest sum; the first such, empty where all are negative."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("run"), F.lit(0).alias("begin"), F.lit(0.0).alias("best"), F.lit(0).alias("from"), F.lit(0).alias("to"))

    def step(a: Column, gain: Column) -> Column:
        run = F.greatest(a["run"], F.lit(0.0)) + gain - threshold
        begin = F.when(a["run"] > 0, a["begin"]).otherwise(a["i"])
        return F.struct(
            (a["i"] + 1).alias("i"), run.alias("run"), begin.alias("begin"), F.greatest(a["best"], run).alias("best"),
            F.when(run > a["best"], begin).otherwise(a["from"]).alias("from"), F.when(run > a["best"], a["i"] + 2).otherwise(a["to"]).alias("to"),
        )

    return F.aggregate(_gains(s, ratios), zero, step, lambda a: F.struct(a["from"], a["to"]))


def random_in(m: Column, ratios: list[float], threshold: float) -> Column:
    """What of a candidate (struct<start, end, value>) looks random: the whole; or else parts between separators; or else its best window."""
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = F.filter(matches(m["value"], PART), lambda p: llr(p["value"], ratios) > threshold)
    parts = F.transform(found, lambda p: F.struct((m["start"] + p["start"]).alias("start"), (m["start"] + p["end"]).alias("end"), p["value"].alias("value")))
    window = F.filter(F.array(best_window(m["value"], ratios, threshold)), lambda w: w["to"] - w["from"] >= MIN_CANDIDATE)
    window = F.transform(window, lambda w: F.struct((m["start"] + w["from"]).alias("start"), (m["start"] + w["to"]).alias("end"), F.substring(m["value"], w["from"] + 1, w["to"] - w["from"]).alias("value")))
    glued = F.when(m["value"].rlike(PART), parts).otherwise(none)
    return F.when(llr(m["value"], ratios) > threshold, F.array(m)).otherwise(F.when(F.size(glued) > 0, glued).otherwise(window))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches, leftmost and non-overlapping, as an array of struct<start, end, value>: code points, end exclusive; value is the group's text."""
    p = F.lit(pattern)
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, p, F.lit(0))
    values = found if group == 0 else F.regexp_extract_all(text, p, F.lit(group))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["part"])
        end = start + F.length(x["found"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("out"))

    def part(z: Column, c: Column) -> Column:
        """The c-th CHUNK matches, with positions from the end of the match before them."""
        these = F.transform(F.sequence(c * CHUNK + 1, F.least((c + 1) * CHUNK, F.size(z))), lambda i: F.element_at(z, i))
        return F.aggregate(these, F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    # A fold copies what it has gathered at each step, so it gathers few at a time, and then the chunks.
    def gather(acc: Column, p: Column) -> Column:
        return F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), p["out"].alias("out")))).alias("out"))

    empty = F.array().cast("array<struct<at:int,out:array<struct<start:int,end:int,value:string>>>>")
    shift = lambda p: F.transform(p["out"], lambda m: F.struct((p["at"] + m["start"]).alias("start"), (p["at"] + m["end"]).alias("end"), m["value"].alias("value")))
    zipped = F.arrays_zip(F.slice(parts, 1, F.size(found)).alias("part"), found.alias("found"), values.alias("value"))
    chunks = lambda z: F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), lambda c: part(z, c))
    all_ = lambda z: F.flatten(F.transform(F.aggregate(chunks(z), F.struct(F.lit(0).alias("at"), empty.alias("out")), gather, lambda acc: acc["out"]), shift))
    return let(zipped, lambda z: F.when(F.size(z) > 0, all_(z)).otherwise(none))


def touches(spans: Column, m: Column) -> Column:
    """Whether one of spans (by start, none over another) has a character of m, by halving: the first that ends behind m's start is the one to look at."""
    zero = F.struct(F.lit(1).alias("lo"), (F.size(spans) + 1).alias("hi"))

    def halve(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        below = F.when(a["lo"] < a["hi"], F.element_at(spans, F.least(mid, F.size(spans)))["end"] <= m["start"])
        return F.struct(F.when(below, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(~below, mid).otherwise(a["hi"]).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    first = F.aggregate(steps, zero, halve, lambda a: a["lo"])
    return F.when(F.size(spans) == 0, False).otherwise(let(first, lambda i: F.when(i <= F.size(spans), F.element_at(spans, F.least(i, F.size(spans)))["start"] < m["end"]).otherwise(False)))


def _long_enough(found: Column, least: int) -> Column:
    return F.filter(found, lambda m: F.length(m["value"]) >= least)


def scan(df: DataFrame, id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id and for each row: spans, an array of struct<start, end, kind> (of all kinds, by start, then kind as listed) and base, those of the base patterns."""
    ratios = log_ratios(*samples())
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    out = df.select(F.col(id).alias(id), text_or_empty(text).alias("_text"))
    order = {k: i for i, k in enumerate(KINDS)}
    as_spans = lambda found, kind: F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(order[kind]).alias("kind"), m["end"].alias("end")))
    for kind, (pattern, group, least) in BASE.items():
        t = F.col("_text")
        got = F.when(t.rlike(MAY[kind]), _long_enough(matches(t, pattern, group), least)).otherwise(none)
        out = out.withColumn(f"_{kind}", as_spans(got, kind))
    out = out.withColumn("_base", F.array_sort(F.concat(*(F.col(f"_{k}") for k in BASE))))
    t = F.col("_text")
    cand = F.when(t.rlike(CANDIDATE), matches(t, CANDIDATE)).otherwise(none)
    taken = lambda m: functools.reduce(lambda a, b: a | b, (touches(F.col(f"_{k}"), m) for k in BASE))
    free = F.filter(cand, lambda m: ~taken(m))
    out = out.withColumn("_free", free).withColumn("_markov", as_spans(F.flatten(F.transform(F.col("_free"), lambda m: random_in(m, ratios, threshold))), "markov"))
    name = F.lit(KINDS)
    named = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(name, s["kind"] + 1).alias("kind")))
    return out.select(id, named(F.array_sort(F.concat("_base", "_markov"))).alias("spans"), named(F.col("_base")).alias("base"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
