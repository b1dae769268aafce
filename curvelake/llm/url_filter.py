"""URL filter: rules on hosts and paths, and a logistic regression on hashed character n-grams for what no rule decides.

Method: every n-gram of n = 3..5 characters of host and path (each framed by ^ and $, and marked as of the host or the
path) is hashed to one of BUCKETS weights; the score is the logistic function of the bias and the mean-scaled sum of the weights.
The model is trained on the driver from a small labelled URL table (labelled(), fixed lists); its features are computed by the
same SQL expressions that score. Scoring is SQL only: there is no Python on the executors.

Cases: a null url or one without "://" has an empty host and path, no rule, and the model's verdict on empty strings (that of the
bias, "allow"). Repeated rows give repeated results. Extra columns, whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, numbers

BUCKETS = 4096
SIZES = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): the longest that fits decides.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

#: The labelled table: hosts to block with paths to block and plain paths, hosts to allow with paths to allow and plain paths, and plain hosts, whose label is that of the path
#: (plain paths on plain hosts are allowed). So both hosts and paths tell labels apart.
BLOCKED_HOSTS = (
    "casino-online.example.com bestcasino.example.net casino-royale.example.org free-slots.example.com megaslots.example.net bets-today.example.org betwin.example.com "
    "sportsbets.example.com cheap-pills-shop.example.net pills-online.example.com discount-pills.example.org rx-pills.example.net spam-links.example.com "
    "spam-mail.example.net link-farm.example.net farm-of-links.example.org adclick-track.example.org tracker-ads.example.net ads-server.example.com clickads.example.org "
    "adult-video.example.org adult-cams.example.net xxx-cams.example.com xxxvideo.example.net free-adult.example.com poker-win.example.org pokerstars-win.example.net win-prize.example.net "
    "prize-winner.example.com free-money.example.com money-for-free.example.org"
).split()
ALLOWED_HOSTS = (
    "news.example.com dailynews.example.net university.example.org open-university.example.com library.example.net city-library.example.org docs.example.com museum.example.org "
    "science-museum.example.net garden.example.net gardening.example.com weather.example.com weather-service.example.org city-council.example.org science.example.net history.example.org "
    "local-history.example.com cooking.example.com sports.example.net sports-news.example.org travel.example.org travel-guide.example.net health.example.com public-health.example.org recipes.example.net "
    "thermal.example.com nation.example.org theatre.example.net station.example.com thread.example.org other.example.net handbook.example.com"
).split()
PLAIN_HOSTS = "northbay.example.com riverside.example.org alder.example.net example.com brook.example.org harbour.example.com stone.example.net meadow.example.org ledger.example.com".split()
BLOCKED_PATHS = (
    "/casino/bonus /play/casino-games /free-slots/play /slots/jackpot /bets/odds-today /place-bets /buy/cheap-pills /pills/discount /spam/offer /ads/banner /ads/click /track/adclick "
    "/adult/cams /adult/video /xxx/video /live/xxx-cams /poker/jackpot /poker/win-big /win-prize/claim /claim/prize /free-money/now /get/free-money"
).split()
ALLOWED_PATHS = (
    "/news/article /news/local /research/paper /docs/manual /docs/install /library/catalogue /recipes/soup /cooking/recipes /weather/forecast /museum/exhibits /history/archive "
    "/local/history /travel/guide /health/advice /science/journal /council/minutes /school/course /garden/plants /sports/results /theatre/programme /about/contact /library/opening-hours"
).split()
PLAIN_PATHS = ("/en/12", "/de/345.html", "/", "/fr/7/", "/es/901")
SUBDOMAINS = ("", "www.", "m.")
#: Every so manieth host and path can be held out, to see what the model makes of names that it hasn't met.
FOLDS = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to / ? # or the end, A-Z lower-cased. Path: from there up to ? # or the end."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null where none does. A rule fits its host and all subdomains of it, if the path starts with the rule's."""
    found = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found


def _grams(s: Column, mark: str, n: int) -> Column:
    """The buckets of s's n-grams; the mark keeps host and path apart."""
    framed = F.split(F.concat(F.lit("^"), s, F.lit("$")), "")

    def grams(c: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(c) - n + 1, F.lit(1)))
        piece = lambda i: F.concat(*(F.coalesce(F.get(c, i + (j - 1)), F.lit("")) for j in range(n)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), piece(i)), F.lit(BUCKETS)).cast("int"))

    return let(framed, grams)


def features(host: Column, path: Column) -> Column:
    return F.concat(*(_grams(s, mark, n) for s, mark in ((host, "h"), (path, "p")) for n in SIZES))


def labelled(spark: SparkSession, held_out: bool | None = None) -> DataFrame:
    """host, path, label. held_out: only names of the last fold (plain ones as they are), or all but those; none: all."""
    pick = lambda names: [x for i, x in enumerate(names) if held_out is None or (i % FOLDS == FOLDS - 1) == held_out]
    bad, good, bad_paths, good_paths = map(pick, (BLOCKED_HOSTS, ALLOWED_HOSTS, BLOCKED_PATHS, ALLOWED_PATHS))
    pairs = [(bad, [*bad_paths, *PLAIN_PATHS], 1), (good, [*good_paths, *PLAIN_PATHS], 0), (PLAIN_HOSTS, bad_paths, 1), (PLAIN_HOSTS, [*good_paths, *PLAIN_PATHS], 0)]
    rows = sorted({(s + h, p, y) for hosts, paths, y in pairs for i, h in enumerate(hosts) for j, p in enumerate(paths) for s in (SUBDOMAINS[(i + j) % len(SUBDOMAINS)],)})
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', {y})" for h, p, y in rows) + " AS t(host, path, label)")


def train(spark: SparkSession, rounds: int = 8, rate: float = 0.5, decay: float = 1e-4, held_out: bool | None = None) -> list[float]:
    """BUCKETS weights and the bias. The labelled table is a fixed list, so what is collected here is bounded."""
    rows = labelled(spark, held_out).select("label", features(F.col("host"), F.col("path")).alias("f")).orderBy("host", "path").collect()
    w = [0.0] * (BUCKETS + 1)
    seen = [0.0] * (BUCKETS + 1)  # squared gradients, for steps by each weight's history
    for _ in range(rounds):
        for row in rows:
            scale = 1 / math.sqrt(len(row["f"]))
            z = w[BUCKETS] + scale * sum(w[i] for i in row["f"])
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - row["label"]
            for i, x in [(BUCKETS, g), *((i, g * scale) for i in row["f"])]:
                x += decay * w[i]
                seen[i] += x * x
                w[i] -= rate * x / math.sqrt(seen[i] + 1e-8) if seen[i] else 0.0
    return [round(x, 6) for x in w]


def score(host: Column, path: Column, weights: list[float]) -> Column:
    """Probability that the url is one to block."""
    table = numbers(weights[:BUCKETS])
    f = features(host, path)
    total = F.aggregate(f, F.lit(0.0), lambda a, i: a + F.element_at(table, i + 1))
    z = F.lit(weights[BUCKETS]) + total / F.sqrt(F.size(f))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def judge(df: DataFrame, url: str = "url", rules=RULES, weights: list[float] | None = None, threshold: float = 0.5) -> DataFrame:
    """df's rows with host, path, rule, verdict, and score (that of the model, also where a rule decides)."""
    weights = weights or train(df.sparkSession)
    host, path = host_and_path(F.col(url))
    keep = [c for c in df.columns if c not in ("host", "path", "rule", "verdict", "score")]
    out = df.select(*keep, host.alias("host"), path.alias("path"))
    out = out.withColumn("score", score(F.col("host"), F.col("path"), weights)).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    return out.select(
        *keep, "host", "path",
        F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
